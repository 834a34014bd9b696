"""Path masks compiled to regular expressions that Spark evaluates inside the scan stage.

Syntax: `*` spans folders, `?` is one character inside a segment, a leading `/` anchors at the root,
a leading `*/` also matches at the root, a trailing `:` restricts to files, a trailing `/` or `/*`
names a directory with everything below it. An exclude line starting with `!` is an exception.
Matching is done on the folded path (NFC, upper case).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, text

NEVER = r"(?!)"

# Preset name -> mask lines, in their listed order.
JUNK_PRESETS: dict[str, list[str]] = {
    "windows": [
        "*/System Volume Information/", "*/$RECYCLE.BIN/", "*/RECYCLE?/", "*/Recovery/",
        "*/Thumbs.db", "*/desktop.ini",
    ],
    "macos": [
        "*/.Spotlight-V100/", "*/.fseventsd/", "*/.Trashes/", "*/.TemporaryItems/",
        "*/.DocumentRevisions-V100/", "*/.DS_Store", "*/._*",
    ],
    "linux": ["*/.Trash-*/", "*/lost+found/", "*/.directory", "*/.fuse_hidden*", "*/.nfs*"],
    "dev": [
        "*/.git/", "*/node_modules/", "*/target/", "*/build/", "*/dist/", "*/__pycache__/",
        "*/.venv/", "*/venv/", "*/worktrees/", "*/sync.ffs_db", "*/sync.ffs_lock",
    ],
    "ide": ["*/.idea/", "*/.vscode/", "*/.vs/", "*/.history/", "*/*.swp", "*/*.swo", "*/*~"],
    "office": ["*/~$*", "*/.~lock.*#", "*/*.laccdb", "*/*.wbk"],
    "synctool": [
        "*/.dropbox", "*/.dropbox.attr", "*/.dropbox.cache/", "*/.stfolder/", "*/.stversions/",
        "*/.stignore", "*/.syncthing.*", "*/.sync/", "*/*.icloud",
    ],
}
DEFAULT_PRESETS = ["windows", "macos"]


def folded_line(line: str) -> str:
    """The form in which two mask lines are the same rule."""
    return unicodedata.normalize("NFC", line.strip()).upper().replace("\\", "/")


def same_line(a: str, b: str) -> bool:
    return folded_line(a) == folded_line(b)


def preset_ids(ids: list[str]) -> list[str]:
    """Trimmed ids; blanks and `none` drop out, an unknown id is refused."""
    wanted = [i.strip() for i in ids if i.strip() and i.strip().lower() != "none"]
    for i in wanted:
        if i.lower() not in JUNK_PRESETS:
            raise ValueError(f"unknown junk preset '{i}' (known: {', '.join(JUNK_PRESETS)}, or `none`)")
    return wanted


def expand_presets(ids: list[str]) -> list[str]:
    """Preset ids to mask lines in table order, each rule once."""
    wanted = {i.strip().lower() for i in ids}
    lines: dict[str, str] = {}
    for preset, patterns in JUNK_PRESETS.items():
        if preset in wanted:
            for p in patterns:
                lines.setdefault(folded_line(p), p)
    return list(lines.values())


def _regex(mask: str, with_children: bool) -> str:
    """One mask to an anchored Java regex.

    A run of `*` at the end accepts any rest. A run in the middle stands for any text before the
    character that follows it. With `with_children` the match may end at a folder bound.
    """
    out, rest = [], re.sub(r"\*+", "*", mask)
    open_end = rest.endswith("*")
    for ch in rest.rstrip("*") if open_end else rest:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(ch))
    tail = ".*" if open_end else ("(?:/.*)?" if with_children else "")
    return "".join(out) + tail


def _begin_regex(mask: str) -> str | None:
    """Folders from which something matching the mask may still be reached."""
    literal = mask.split("*", 1)[0]
    parts: list[str] = []
    for i in range(len(literal)):
        if literal[i] == "/" and i + 1 < len(mask):
            parts.append("".join("[^/]" if c == "?" else re.escape(c) for c in literal[:i]))
    if "*" in mask:
        parts.append("".join("[^/]" if c == "?" else re.escape(c) for c in literal) + ".*")
    return "|".join(f"(?:{p})" for p in parts) or None


@dataclass
class MaskSet:
    """Masks split by what they may hit."""

    files: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, lines: list[str]) -> "MaskSet":
        made = cls()
        for line in lines:
            norm = folded_line(line)
            if not norm:
                continue
            if norm.startswith("/"):
                made._add(norm[1:])
                continue
            made._add(norm)
            if norm.startswith("*/"):
                made._add(norm[2:])
        return made

    def _add(self, tail: str) -> None:
        if tail.endswith(":"):
            self._keep(self.files, tail[:-1])
        elif tail.endswith("/"):
            self._keep(self.folders, tail.rstrip("/"))
        elif tail.endswith("/*"):
            self._keep(self.folders, tail[:-2])
        else:
            self._keep(self.files, tail)
            self._keep(self.folders, tail)

    @staticmethod
    def _keep(where: list[str], mask: str) -> None:
        if mask and mask not in where:
            where.append(mask)

    def file_regex(self) -> str:
        """A file is hit by a file mask itself, or by a folder mask on its parent."""
        own = [_regex(m, False) for m in self.files]
        under = [_folder_of_file(m) for m in self.folders]
        return _any(own + under)

    def folder_regex(self) -> str:
        return _any([_regex(m, True) for m in self.folders])

    def begin_regex(self) -> str:
        found = [_begin_regex(m) for m in self.files + self.folders]
        return _any([f for f in found if f])


def _folder_of_file(mask: str) -> str:
    """The parent of the path matches the folder mask, so one more segment follows."""
    return _regex(mask, True) + "/[^/]*"


def _any(alternatives: list[str]) -> str:
    if not alternatives:
        return NEVER
    return r"(?s)\A(?:" + "|".join(f"(?:{a})" for a in alternatives) + r")\z"


class PathFilter:
    """Include, exclude, exception and deletable masks as Column predicates over a folded path."""

    def __init__(
        self,
        includes: list[str] | None = None,
        excludes: list[str] | None = None,
        deletables: list[str] | None = None,
        reserved: names.ReservedNames = names.RESERVED,
    ):
        self.reserved = reserved
        self.include = MaskSet.of(includes or ["*"])
        exceptions = [e.strip()[1:].strip() for e in excludes or [] if e.strip().startswith("!")]
        exceptions = [e for e in exceptions if e]
        self.exceptions_anywhere = any(not e.startswith("/") for e in exceptions)
        self.exceptions = MaskSet.of(exceptions)
        self.exclude = MaskSet.of(
            reserved.masks() + [e for e in excludes or [] if not e.strip().startswith("!")]
        )
        self.deletable = MaskSet.of(deletables or [])

    def passes_file(self, folded: str = "folded", path: str = "path") -> Column:
        p = F.col(folded)
        return (
            ~names.is_temp_path(path, self.reserved)
            & (p.rlike(self.exceptions.file_regex()) | ~p.rlike(self.exclude.file_regex()))
            & p.rlike(self.include.file_regex())
        )

    def passes_directory(self, folded: str = "folded") -> Column:
        """struct(enters, descends)."""
        p = F.col(folded)
        excluded = ~p.rlike(self.exceptions.folder_regex()) & p.rlike(self.exclude.folder_regex())
        below_exception = (
            p.rlike(self.exceptions.begin_regex()) if self.exceptions_anywhere else F.lit(False)
        )
        included = p.rlike(self.include.folder_regex())
        return F.struct(
            (~excluded & included).alias("enters"),
            F.when(excluded, below_exception)
            .otherwise(included | p.rlike(self.include.begin_regex()))
            .alias("descends"),
        )

    def is_deletable(self, folded: str = "folded", path: str = "path") -> Column:
        return names.is_temp_path(path, self.reserved) | F.col(folded).rlike(self.deletable.file_regex())


def mask_hits(masks: list[str], folded: str = "folded") -> Column:
    """Whether any of the ad-hoc masks hits the path; no include list, no built-in excludes."""
    return F.col(folded).rlike(MaskSet.of([m for m in masks if m.strip()]).file_regex())


def folded_path(df, path: str = "path", name: str = "folded", clean: bool = False):
    """Add the folded path the predicates read; `clean` also trims and unifies separators."""
    if clean:
        df = df.withColumn("_clean", F.replace(F.trim(path), F.lit("\\"), F.lit("/")))
        return df.withColumn(name, text.fold("_clean")).drop("_clean")
    return df.withColumn(name, text.fold(path))
