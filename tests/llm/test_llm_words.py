"""Spelling variants, fill-in-the-middle and licence scans against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from dialogmill.llm import fill_in_middle, license_scan, spelling

DOC = "doc_id long, text string, word string"
LONG = "lettère %s\n" * 60_000 % tuple("abcdefgh"[i % 8] * 6 for i in range(60_000))  # about 1 MB
EDGES = [(0, "abcde abcde abcde abcdf", "x"), (1, None, "x"), (2, "", None), (3, " \n\t\n ", "y"), (4, LONG, "y"), (5, "abcde\nAbcDe", "x"), (5, "abcde\nAbcDe", "x"), (None, "lost id\nlost id, MIT License", "z"), (6, "x" * 5000, "z")]


@pytest.fixture(scope="module")
def edges(spark):
    out = spark.createDataFrame(EDGES, DOC)
    for name in ("n", "key", "form", "labels", "output"):
        out = out.withColumn(name, F.lit("?"))
    return out


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def as_documents(con_dir, rows, tmp_path):
    """A DuckDB connection in which documents is what is given."""
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), tmp_path / "d.parquet")
    con = duck(con_dir)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    return con


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, every=97, least_n=3):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= least_n}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize(("alphabet", "most"), [("ab", 1), ("ab", 3), ("aé", 32), ("abcdefgh", 1), ("abcdefgh", 32)])
def test_spelling_against_all_pairs(spark, alphabet, most):
    rng = random.Random(f"{alphabet}{most}")
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 12))) for _ in range(25)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(base[: rng.randint(1, 25)])
            at = rng.randrange(len(w))
            words.append([w, w, w, w[:at] + rng.choice(alphabet) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet).upper() + w[at + 1 :]][rng.randrange(6)])
        docs.append((i, " ".join(words), None))
    got = spelling.spelling_variants(spark.createDataFrame(docs, DOC), every=7, most=most).collect()
    assert {tuple(r) for r in got} == plain_variants([d[:2] for d in docs], every=7) and len(got) > 20
    assert any(r["root"] != (r["form"] or r["word"]) for r in got)


def test_common_segments_are_cut_again_and_no_pair_is_lost(spark):
    """Many words that share both a half and a quarter: the pairs that are looked at stay far below all pairs."""
    words = sorted({"abcdef" + f"{a}{b}{c}{d}" for a in "xyz" for b in "pqrs" for c in "klmn" for d in "ghij"})
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    for most in (1, 4, 10_000):
        got = [(r["a"], r["b"]) for r in spelling.near_words(rows, most).collect()]
        assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_spelling_edges(spark, sf_dir, edges, nothing, tmp_path):
    got = spelling.spelling_variants(edges)
    assert differences(got, spelling.OP11_SQL, as_documents(sf_dir, EDGES, tmp_path)) is None
    assert {tuple(r) for r in got.collect()} == plain_variants([r[:2] for r in EDGES])
    assert spelling.spelling_variants(nothing).count() == 0
    assert spelling.spelling_variants(edges.where("doc_id <= 3"), least_n=9).count() == 0


# --- fill in the middle


def units_of(text, kind):
    return re.findall({"line": r"[^\n]*\n|[^\n]+", "word": r"[^\t-\r ]+[\t-\r ]*|[\t-\r ]+", "char": r"[\s\S]"}[kind], text)


def plain_middle(doc_id, text, kind="line", rate=100, first=50):
    text = text or ""
    parts = units_of(text, kind)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    p, m, s = "".join(parts[:i]), "".join(parts[i:j]), "".join(parts[j:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, len(parts), "plain", None, None, text
    if h[3] % 100 < first:
        return doc_id, len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = ["a<P>b", "<S>", "x\n<M>", "<P", "S>", "<Q>", "<<P>>", "a<\nP>", "ends<", "P>starts", "é\n\n😀", "\n", "\n\n", "no end", "end\n", "日本\n語", " a  b ", "a\tb\r\nc\x0bd"]


@pytest.mark.parametrize(("kind", "rate"), [("line", 100), ("line", 40), ("word", 100), ("char", 100)])
def test_fill_in_middle_against_a_plain_version(spark, kind, rate):
    rng = random.Random(3)
    texts = [*MARKED, *["".join(rng.choice("ab é😀\n\n<>PSM") for _ in range(rng.randrange(40))) for _ in range(200)]]
    docs = [(i, t, None) for i, t in enumerate(texts)]
    got = fill_in_middle.fill_in_middle(spark.createDataFrame(docs, DOC), kind, rate=rate)
    back = {r["doc_id"]: r["t"] for r in got.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert {tuple(r) for r in got.collect()} == {plain_middle(i, t, kind, rate) for i, t, _ in docs}
    assert back == {i: t for i, t, _ in docs}


@pytest.mark.parametrize("most", [1, 7, 50, 1 << 20])
def test_blocks_do_not_change_cuts(most):
    texts = pa.array([*MARKED, "", "", "a\n" * 50, "é\n" * 3])
    digests = pa.array([hashlib.sha256(f"7:{i}".encode()).digest() for i in range(len(texts))])
    rows = []
    for at, n in fill_in_middle.blocks(texts, most):
        rows += zip(*(c.to_pylist() for c in fill_in_middle.transformed(texts.slice(at, n), digests.slice(at, n), "line", 100, 50)), strict=True)
    assert rows == [plain_middle(i, t)[1:] for i, t in enumerate(texts.to_pylist())]


def test_fill_in_middle_edges(spark, sf_dir, edges, nothing, tmp_path):
    got = fill_in_middle.fill_in_middle(edges)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_middle(*r[:2]) for r in EDGES)
    assert fill_in_middle.fill_in_middle(nothing).count() == 0
    con = as_documents(sf_dir, EDGES, tmp_path)
    edges.select("doc_id", "text").write.parquet(f"file://{tmp_path}/in/documents.parquet")
    assert differences(fill_in_middle.op12_fill_in_middle(spark, f"file://{tmp_path}/in"), fill_in_middle.OP12_SQL, con) is None
    with pytest.raises(ValueError):
        fill_in_middle._begins("page")


# --- licence scans

TEMPLATES = [("t", "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> delta <<var;most=2>> omega"), ("u", "<<beginOptional>>the<<endOptional>> delta omega")]


def accepts(label, template, words):
    return license_scan.Automaton(label, template).places([w.encode() for w in words.split()])


def test_template_regions():
    one = TEMPLATES[0]
    assert accepts(*one, "x alpha delta omega y") == [(1, 4)]
    assert accepts(*one, "alpha beta delta one two omega") == [(0, 6)] == accepts(*one, "alpha beta gamma delta one omega")
    assert accepts(*one, "alpha gamma delta omega") == [] == accepts(*one, "alpha delta one two three omega") == accepts(*one, "alpha omega")
    assert accepts(*one, "alpha alpha delta omega alpha beta delta omega omega") == [(1, 4), (4, 9)]  # the longest, without overlap
    assert accepts(*TEMPLATES[1], "the delta omega delta omega the the delta omega") == [(0, 3), (3, 5), (6, 9)]
    for bad in ("a <<endOptional>>", "<<beginOptional>> a", "<<beginOptional>>a<<endOptional>>", "<<var;most=3>>", ""):
        with pytest.raises(ValueError):
            license_scan.Automaton("bad", bad)


def test_places_against_regular_expressions():
    rng = random.Random(8)
    for _ in range(400):
        items = [rng.choice("abc")]
        for _ in range(rng.randrange(5)):
            items.append(rng.choice(["a", "b", "c", "<<var;most=2>>", "<<beginOptional>>a b<<endOptional>>", "<<beginOptional>>c <<beginOptional>>a<<endOptional>><<endOptional>>"]))
        template = " ".join([*items, rng.choice("abc")])
        words = " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))
        auto = license_scan.Automaton("x", template)
        pattern = re.compile(f"(?:{license_scan._pattern(license_scan.parse(template))})$")
        split, want, at = words.split(), [], 0
        while at < len(split):  # leftmost, then longest, by trying all ends
            ends = [e for e in range(len(split), at, -1) if pattern.match("".join(w + " " for w in split[at:e]))]
            want += [(at, ends[0])] if ends else []
            at = ends[0] if ends else at + 1
        assert auto.places([w.encode() for w in split]) == want, (template, words)
        scanner = license_scan.Scanner([("x", template)], [])
        n, *_, labels, score, spans = scanner.scan(words.replace(" ", ",\n"))
        assert spans == [("x", a, b) for a, b in want] and labels == ("x" if want else "") and score == (auto.mandatory / n if want else 0)


def plain_base(text, phrases=license_scan.PHRASES):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for p, label in phrases:
        own = p.split()
        here = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_whole_licences_are_accepted_and_changed_ones_are_not():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    for label, template in license_scan.TEMPLATES:
        whole = re.sub(r"<<(begin|end)Optional>>", "", re.sub(r"<<var;most=\d+>>", "Some Body", template))
        short = re.sub(r"<<var;most=\d+>>", "", re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", "", template, flags=re.S))
        for text in (whole, f"// {whole.upper()}\n/* more */ code()"):
            assert label in scanner.scan(text)[5].split(","), label
        words = short.split()
        changed = " ".join([words[0], "never", *words[1:]])
        assert (label, 0) not in [(x, a) for x, a, _ in scanner.scan(changed)[7]], label
    assert scanner.scan("Released under the MIT License.")[4:7] == ("mit", "mit", 1.0)
    assert scanner.scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc-4.0")


def test_base_places_against_a_plain_version():
    rng = random.Random(2)
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    pieces = ["MIT", "license", "License,", "mit license", "GNU General", "Public License", "é", "cc", "BY", "-", "\n", "Apache", "7", "x\x7fy", "licensé", "日本"]
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert scanner.scan(text)[:5] == plain_base(text)


def test_scan_of_a_long_text_is_linear():
    import time

    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    text = "This work is licensed under the MIT License, word. " * 20_000
    began = time.process_time()
    got = scanner.scan(text)
    assert got[1] == 20_000 and len(got[7]) == 20_000 and got[5] == "mit" and time.process_time() - began < 20


def test_license_edges(spark, sf_dir, edges, nothing, tmp_path):
    got = license_scan.license_scan(edges).drop("spans")
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter((r[0], *plain_base(r[1])) for r in EDGES)
    assert differences(got, license_scan.OP13_SQL, as_documents(sf_dir, EDGES, tmp_path)) is None
    assert license_scan.license_scan(nothing).count() == 0


def test_templates_from_a_table(spark):
    rows = spark.createDataFrame([*TEMPLATES, ("none", None)], "label string, template string")
    templates = license_scan.load_templates(rows)
    docs = spark.createDataFrame([(1, "Alpha, beta! delta: x omega", None)], DOC)
    assert templates == sorted(TEMPLATES)
    assert [r["spans"] for r in license_scan.license_scan(docs, templates).collect()] == [[("t", 0, 5)]]
    with pytest.raises(ValueError):
        license_scan.load_templates(rows, 1)


def test_kernel_numbers_units_of_each_document():
    raw, offsets = fill_in_middle.buffers(pa.array(["skip", "a\nb", "", "\n\n", "c"]).slice(1))
    assert offsets.tolist() == [0, 3, 3, 5, 6]
    cut = fill_in_middle.cuts(raw, offsets, np.array([[1, 2], [5, 7], [1, 0], [1, 1]]))
    assert cut["n"].tolist() == [2, 0, 2, 1] and cut["first"].tolist() == [2, 3, 3, 6] and cut["second"].tolist() == [3, 3, 4, 6]


def test_hot_words_and_repeated_rows_count(spark):
    rows = [(i, "commen " + "common " * 200, None) for i in range(50)] * 2
    by = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, DOC)).collect()}
    assert by["commen"]["form"] == "common" and by["common"]["n"] + by.get("commo", {"n": 0})["n"] > 10_000
