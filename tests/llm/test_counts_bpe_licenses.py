"""Token counts, byte-level BPE and license scans."""

import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from treeledger.llm import bpe, licenses
from treeledger.llm.counts import Counter, token_counts

from .helpers import frame, odd_rows

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def random_text(r: random.Random) -> str:
    pool = [r.randint(32, 126), r.randint(0x80, 0x24F), r.randint(0x3000, 0x9FFF), r.randint(0x10000, 0x1FFFF), 10, 32, 32, 0xA0, 0x2003, 0x85]
    return "".join(chr(r.choice([*pool, r.randint(97, 110)])) for _ in range(r.randint(0, 60)))


def test_counts_equal_the_library(spark):
    rows = [*odd_rows(), (200, "a<|endoftext|>b <|endoftext|> c", "en", "a", 1, "", "", "")]
    library = Tokenizer.from_file(JSON)
    got = token_counts(frame(spark, rows), JSON, limit=20).collect()
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 20) for k, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(frame(spark, []), JSON).collect() == []


def test_counting_in_parts_changes_nothing(monkeypatch):
    monkeypatch.setattr("treeledger.llm.counts.PART_CHARS", 7)
    monkeypatch.setattr("treeledger.llm.counts.REMEMBERED", 5)
    with open(JSON, "rb") as f:
        counter = Counter(f.read())
    library, r = Tokenizer.from_file(JSON), random.Random(2)
    texts = [random_text(r) for _ in range(500)] + [" ", "  a", "a  b", " a b ", "a \n b", "don't  can't"]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return bpe.Coder(f.read(), public_tokenizers.PATTERN)


def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(coder, monkeypatch):
    monkeypatch.setattr(bpe, "PART_WORDS", 8)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    r = random.Random(3)
    texts = [random_text(r) for _ in range(800)] + ["", "a" * 3000, "".join(r.choice("abcdeéö") for _ in range(2000)), "x" * 49]
    for t in texts:
        ids = coder.encode(t)
        assert ids == library(coder).encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_words_that_come_back_are_kept_in_little_memory(monkeypatch):
    """120,000 words twice: each is folded once, and what is known of it takes less than 0.3 KB."""
    folded, runs = [], bpe.Folder.runs
    monkeypatch.setattr(bpe.Folder, "runs", lambda self, words: folded.append(len(words)) or runs(self, words))
    with open(RANKS, "rb") as f:
        own = bpe.Coder(f.read(), public_tokenizers.PATTERN)
    names = ["".join(chr(106 + int(c, 16)) for c in f"{i * 40_503 % (1 << 24):06x}") for i in range(120_000)]
    texts = [" ".join(names[i : i + 1000]) for i in range(0, len(names), 1000)]
    tracemalloc.start()
    found = [[*own.digests(texts)] for _ in range(2)]
    size = tracemalloc.get_traced_memory()[0] / (len(own.lines) + len(own.old[0]))
    tracemalloc.stop()
    assert found[0] == found[1] and sum(folded) <= len(names)
    for i in (0, 70, 119):
        ids = library(own).encode_ordinary(texts[i])
        assert found[0][i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
    assert size < 300


def test_a_group_of_texts_is_encoded_like_its_texts(coder, monkeypatch):
    """Known, old, whole, short and long words stand side by side; few words are remembered."""
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 300)
    monkeypatch.setattr(bpe, "PART_WORDS", 400)
    monkeypatch.setattr(bpe, "MANY", 4)
    r = random.Random(5)
    texts = [*(random_text(r) for _ in range(600)), "", " ", "a", "the of and", "xyzzy" * 300, "qzx " * 500, "", "y" * 70 + " qqzzxx ppkkvv wwjjhh ddtt zzq"]
    r.shuffle(texts)
    encoder = library(coder)
    want = [(len(ids := encoder.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts]
    assert [*coder.digests(texts)] == want


def test_bpe_tables(spark, coder):
    rows = odd_rows()
    docs = frame(spark, rows)
    encoder = library(coder)
    got = sorted(map(str, map(tuple, bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect())))
    want = []
    for k, t, *_ in rows:
        ids = encoder.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(map(str, want))
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in rows)
    assert bpe.encode_decode(frame(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_fold_in_dataframe_functions_gives_the_same_ids(spark, coder):
    words = [" theable", "été", "x", "", None, " unquestionably", "日本語", "aaaaaaa", "!!!"]
    got = bpe.encoded_words(spark.createDataFrame([(w,) for w in words], "word string"), coder.ranks).collect()
    assert {r.word: list(r.ids) for r in got} == {w: coder.encode(w or "") for w in words}


def test_patience_alignment_is_a_rising_run_of_equal_words():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= len(licenses.common(a, b))
    assert len(licenses.align([*"abcdef"], [*"abXdef"])) == 5
    assert licenses.increasing([3, 1, 2, 5, 4]) == [1, 2, 4]


def test_license_hits(spark):
    r = random.Random(5)
    filler = lambda n: " ".join(r.choice(["of", "the", "thin", "oran", "license"]) for _ in range(n))
    changed = licenses.TEMPLATES["MIT-text"].split()
    for i in range(7, len(changed), 9):
        changed[i] = "changed"
    apache = licenses.TEMPLATES["Apache-2.0"]
    texts = {
        1: filler(50) + " " + apache + " " + filler(50), 2: licenses.TEMPLATES["Apache-2.0-header"], 3: " ".join(changed),
        4: filler(4000), 5: apache + "\n" + filler(3) + "\n" + apache, 6: None, 7: "", 8: "Licensed under something else entirely",
    }
    docs = frame(spark, [(k, t, "en", "a", 1, "", "", "") for k, t in texts.items()])
    got = {x.doc_id: x for x in licenses.license_scan(docs).collect()}
    names = {k: [h.split(":")[0] for h in x.licenses.split(",") if h] for k, x in got.items()}
    assert names == {1: ["Apache-2.0"], 2: ["Apache-2.0-header"], 3: ["MIT-text"], 4: [], 5: ["Apache-2.0"] * 2, 6: [], 7: [], 8: []}
    start, end = map(int, got[1].licenses.split(":")[1:3])
    assert texts[1][start:end] == apache.rstrip(".")
    assert 0.8 <= got[3].best_coverage < 0.95
    assert licenses.license_scan(frame(spark, [])).collect() == []


def test_a_misplaced_mark_hides_no_license():
    """"license" stands twice in the template; its second place in the text must not spoil the first word's window."""
    scan = licenses.Scanner(licenses.TEMPLATES)
    text = "License license " + licenses.TEMPLATES["Apache-2.0"]
    assert [h.name for h in scan(text)] == ["Apache-2.0"]
    for n in range(12):
        assert [h.name for h in scan("version " * n + licenses.TEMPLATES["GPL-3.0"] + " license" * n)] == ["GPL-3.0"], n


def test_scan_equals_alignment_at_every_position():
    """Each template aligned with the window at every place of a text finds the same licenses as the places that marks propose."""
    scan, r = licenses.Scanner(licenses.TEMPLATES), random.Random(6)
    filler = "the of a thin oran work license under version in this bet".split()
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 2)):
            own = licenses.TEMPLATES[r.choice([n for n, t in licenses.TEMPLATES.items() if len(t) < 200])].split()
            for _ in range(r.randint(0, 1 + len(own) // 6)):
                own[r.randrange(len(own))] = r.choice(filler)
            parts += [*[r.choice(filler) for _ in range(r.randint(0, 9))], *own]
        text = " ".join(parts + [r.choice(filler) for _ in range(5)])
        own, _ = licenses.words(text)
        want = set()
        for name, template in scan.templates.items():
            least, slack = scan.coverage * len(template), 2 + len(template) // 4
            for begin in range(len(own)):
                pairs = scan._dense(licenses.align(template, own[begin : begin + len(template) + slack]), least)
                if pairs and scan.telling[name] <= {template[x] for x, _ in pairs}:
                    want.add(name)
        got = {h.name for h in scan(text)}
        assert got <= want and bool(got) == bool(want), (text, got, want)


def test_close_licenses_are_told_apart():
    scan = licenses.Scanner(licenses.TEMPLATES)
    for name in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"):
        assert [h.name for h in scan("Text. " + licenses.TEMPLATES[name] + " More.")] == [name]
    assert scan("Licensed under CC BY-XX 4.0.") == []


def test_texts_of_many_near_misses_cost_little():
    import time

    scan, start = licenses.Scanner(licenses.TEMPLATES), time.perf_counter()
    assert scan("apache license warranties conditions x y z " * 22_000) == []  # about 1 MB
    assert time.perf_counter() - start < 20
