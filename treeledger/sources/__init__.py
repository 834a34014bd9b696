"""Readers and writers for inventories, plans, run artifacts and exports."""
