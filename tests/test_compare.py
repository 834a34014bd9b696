"""Decision tables of the three modes, on inventories where every path is one cell of the matrix."""

from tests.helpers import file, folder, inventory, link, shown
from treeledger.operators.compare import Options
from treeledger.plans.compare import compare, plan_header

NFC, NFD = "caf\u00e9.txt", "cafe\u0301.txt"


def by_path(rows):
    return {(r[2], r[0]): (r[1], r[3], r[4]) for r in rows}


def test_sync_matrix_with_archive(spark):
    source = inventory(
        spark, file("same", "h1"), file("s-new", "h2"), file("t-new", "h1"), file("both", "h2"), file("del-t", "h1"),
        file("del-t-changed", "h2"), file("moved/b", "m"), file("added", "n"), file("s-behind", "old"), file("t-behind", "cur"),
        file("equal-gen", "p1"), file("fresh-both", "x1"),
    )
    target = inventory(
        spark, file("same", "h1"), file("s-new", "h1"), file("t-new", "h2"), file("both", "h3"), file("del-s", "h1"),
        file("del-s-changed", "h2"), file("orig/b", "m"), file("t-added", "q"), file("s-behind", "cur"), file("t-behind", "old"),
        file("equal-gen", "p1b"), file("fresh-both", "x2"),
    )
    archive = inventory(
        spark, file("same", "h1"), file("s-new", "h1"), file("t-new", "h1"), file("both", "h1"), file("del-t", "h1"), file("del-t-changed", "h1"),
        file("del-s", "h1"), file("del-s-changed", "h1"), file("orig/b", "m"), file("s-behind", "cur", previous=["old"]),
        file("t-behind", "cur", previous=["old"]), file("equal-gen", "z"), kind="archive",
    )
    got = by_path(shown(compare(source, target, "sync", archive=archive)))
    assert got == {
        ("s-new", "update"): ("target", None, "source-changed"),
        ("t-new", "update"): ("source", None, "target-changed"),
        ("both", "conflict"): ("target", None, "both-changed"),
        ("del-t", "delete"): ("source", None, "deleted-on-target"),
        ("del-t-changed", "conflict"): ("target", None, "deleted-on-target-but-changed-on-source"),
        ("del-s", "delete"): ("target", None, "deleted-on-source"),
        ("del-s-changed", "conflict"): ("target", None, "deleted-on-source-but-changed-on-target"),
        ("moved/b", "move"): ("target", "orig/b", "move-on-source-replayed"),
        ("added", "copy"): ("target", None, "added-on-source"),
        ("t-added", "copy"): ("source", None, "added-on-target"),
        ("s-behind", "update"): ("source", None, "source-behind-by-generations"),
        ("t-behind", "update"): ("target", None, "target-behind-by-generations"),
        ("equal-gen", "conflict"): ("target", None, "both-changed"),
        ("fresh-both", "conflict"): ("target", None, "both-changed"),
    }


def test_mirror_folds_names_and_keeps_target_spelling(spark):
    source = inventory(spark, file(NFC, "h2"), file("A/B.txt", "k"), file("stra\u00dfe", "s"), link("ln", "x"), link("only", "y"))
    target = inventory(
        spark, file(NFD, "h1"), file("a/b.TXT", "k"), file("STRASSE", "s"), link("ln", "z"), link("gone", "g"), folder("a"), folder("old/deep"), folder("old")
    )
    assert shown(compare(source, target, "mirror")) == [
        ("update", "target", NFD, None, "differs-master-wins"),
        ("update", "target", "ln", None, "symlink-differs-master-wins"),
        ("copy", "target", "only", None, "symlink-only-in-source"),
        ("delete", "target", "gone", None, "symlink-gone-from-source"),
        ("delete_dir", "target", "old/deep", None, "dir-gone-from-source"),
        ("delete_dir", "target", "a", None, "dir-gone-from-source"),
        ("delete_dir", "target", "old", None, "dir-gone-from-source"),
    ]


def test_twins_are_noted_and_the_first_path_wins(spark):
    source = inventory(spark, file("A.txt", "1"), file("a.txt", "2"), file("b", "3"))
    target = inventory(spark, file("a.txt", "1"), file("b", "3"), file("B", "4"))
    got = shown(compare(source, target, "mirror"))
    assert got == [
        ("update", "target", "B", None, "differs-master-wins"),
        ("note", "source", "a.txt", None, "duplicate-after-normalization (kept first; NFC/case twin)"),
        ("note", "target", "b", None, "duplicate-after-normalization (kept first; NFC/case twin)"),
    ]


def test_unread_areas_are_left_alone_on_both_sides(spark):
    source = inventory(spark, file("docs-old/a", "1"), folder("keep"), unread=["docs", "deep/x/y"])
    target = inventory(
        spark, file("docs/a.txt", "1"), file("DOCS/b.txt", "2"), file("docs-old/a", "1"), file("deep/x/y/z", "9"), file("deep/x/other", "8"),
        folder("deep"), folder("deep/x"), folder("deep/x/y"), folder("gone"), folder("docs"),
    )
    made = compare(source, target, "mirror")
    assert [(r[0], r[2]) for r in shown(made)] == [("delete", "deep/x/other"), ("delete_dir", "gone")]
    head = plan_header(made, 5).first()
    assert (head["op_count"], head["source_entries"], head["target_entries"], head["target_unread_entries"]) == (2, 2, 10, 5)
    assert head["source_unread_paths"] == ["deep/x/y", "docs"]


def test_evidence_rules(spark):
    source = inventory(
        spark, file("u", kind="unreadable"), file("meta", kind="size_and_mtime", mtime=0), file("meta2", kind="size_and_mtime", mtime=0),
        file("mixed", "d", kind="sampled"), file("older", "a", mtime=1000), file("newer", "a", mtime=9000),
    )
    target = inventory(
        spark, file("u", "x"), file("meta", kind="size_and_mtime", mtime=2000), file("meta2", kind="size_and_mtime", mtime=2001),
        file("mixed", "d", kind="full"), file("older", "b", mtime=5000), file("newer", "b", mtime=6999),
    )
    mirror = by_path(shown(compare(source, target, "mirror")))
    unreadable = ("target", None, "evidence-unavailable (content unreadable on one side)")
    assert mirror[("u", "conflict")] == unreadable
    assert {p for p, a in mirror if a == "update"} == {"meta2", "mixed", "older", "newer"}
    enrich = by_path(shown(compare(source, target, "enrich")))
    assert enrich == {("u", "conflict"): unreadable, ("newer", "update"): ("target", None, "source-newer")}


def test_conflict_copies_and_their_limit(spark):
    stamp = "20200101-00000{}-h"
    copies = [file(f"d/r.sync-conflict-{stamp.format(i)}.pdf", "k") for i in range(4)]
    source = inventory(spark, file("d/r.pdf", "s", mtime=10), file("tie", "1", mtime=5), *copies, host="alpha")
    target = inventory(spark, file("d/r.pdf", "t", mtime=3, mode=0o600), file("tie", "2", mtime=5), *copies, host="beta.lan")
    options = Options(conflict="copy", max_conflicts=3)
    got = shown(compare(source, target, "sync", options=options, now_ms=951_782_400_000))
    assert ("move", "target", "d/r.sync-conflict-20000229-000000-beta-lan.pdf", "d/r.pdf", "conflict-loser-kept-as-copy (differs-no-archive)") in got
    assert ("update", "target", "tie", None, "conflict-resolved-newer-wins (loser kept as .sync-conflict copy)") in got
    assert [(r[1], r[2]) for r in got if r[0] == "delete"] == [("source", copies[0][1]), ("target", copies[0][1])]
    assert sum(r[4] == "auto-resolved: differs-no-archive" for r in got) == 2


def test_case_sensitive_collisions(spark):
    source = inventory(spark, file("New.txt", "1"), file("new.txt", "2"), file("Exists", "3"), file("ok", "4"))
    target = inventory(spark, file("exists", "9"))
    got = by_path(shown(compare(source, target, "enrich", options=Options(case_insensitive=False))))
    assert got[("Exists", "conflict")][2] == (
        "case-collision: writing 'Exists' meets the existing 'exists' where case makes no difference; rename one or compare without case"
    )
    assert got[("New.txt", "conflict")][2] == (
        "case-collision: writing 'New.txt' and 'new.txt' would be one file where case makes no difference, "
        "so none is written; rename them or compare without case"
    )
    assert ("ok", "copy") in got and ("new.txt", "conflict") in got


def test_permissions(spark):
    source = inventory(spark, file("a", "1", mode=0o600), file("b", "2", mode=0o755), file("c", "3"), file("n", "4", mode=0o644))
    target = inventory(spark, file("a", "1", mode=0o644), file("b", "x", mode=0o700), file("c", "3", mode=0o644))
    made = compare(source, target, "mirror", options=Options(sync_mode=True))
    rows = {r["path"]: (r["action"], r["mode"], r["reason"]) for r in made.plan().collect()}
    assert rows == {
        "a": ("chmod", 0o600, "mode-differs-master-wins (0644 -> 0600)"),
        "b": ("update", 0o755, "differs-master-wins"),
        "n": ("copy", 0o644, "only-in-source"),
    }
    windows = inventory(spark, file("a", "1", mode=0o644), os="windows")
    assert shown(compare(inventory(spark, file("a", "1", mode=0o600)), windows, "mirror", options=Options(sync_mode=True))) == []


def test_windows_names(spark):
    source = inventory(spark, file("a:b", "1"), file("con.txt", "2"), file("ok", "3"), file("end.", "4"))
    target = inventory(spark, file("con.txt", "9"), os="windows")
    got = by_path(shown(compare(source, target, "mirror")))
    assert got[("a:b", "conflict")][2].startswith("illegal-on-windows: mangled: 'a:b' names a stream of a file there")
    assert got[("end.", "conflict")][2] == (
        "illegal-on-windows: mangled: 'end.' loses its last character and becomes 'end', perhaps another file's name (executing side)"
    )
    assert ("con.txt", "update") in got and ("ok", "copy") in got
