"""Tiny inventories and a brute-force model of the comparison, used only by tests."""

from treeledger.operators.inventory import Header, Inventory
from treeledger.schema import ENTRY


def file(path, digest="d", size=10, mtime=0, kind="full", mode=None, previous=None):
    identity = (kind, digest if kind in ("full", "sampled") else None)
    older = [("full", p) for p in previous] if previous else None
    return ("file", path, size, mtime, identity, None, mode, older, None)


def folder(path):
    return ("directory", path, None, 0, None, None, None, None, None)


def link(path, target):
    return ("symlink", path, None, 0, None, None, None, None, target)


def inventory(spark, *entries, unread=None, **header):
    header.setdefault("host", "h")
    rows = spark.createDataFrame(list(entries), ENTRY).coalesce(1)
    paths = spark.createDataFrame([(u,) for u in unread], "path string").coalesce(1) if unread else None
    return Inventory(rows, Header(**header), paths)


def shown(comparison):
    """(action, side, path, from, reason) in plan order."""
    rows = comparison.plan().orderBy("op_index").collect()
    assert [r["op_index"] for r in rows] == list(range(len(rows)))
    return [(r["action"], r["side"], r["path"], r["from"], r["reason"]) for r in rows]


def greedy_pairs(adds, dels):
    """adds and dels are lists of (key, parent, name); first same parent, else same name, else first."""
    left = sorted(dels)
    out = []
    for key, parent, name in sorted(adds):
        if not left:
            break
        pick = next((d for d in left if d[1] == parent), None) or next((d for d in left if d[2] == name), None) or left[0]
        out.append((key, pick[0], len(left)))
        left.remove(pick)
    return out
