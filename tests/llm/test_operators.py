"""The training-data operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from graphloom.llm import byte_bpe, chat, exact_dedup, html_extract, hyperminhash, license_scan, line_dedup, packing, quality, substring_dedup  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, row_key long, block long, h long"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base, passage = prose(r, 300), prose(r, 60)
    texts = [None, "", " \t ", "one", "a b", base, base, base.replace(" ", "\n"), base.upper(), f"x y {passage} z", f"{passage}\nq", passage + " " + passage, "l1 a\nl2 b\nl3 c\nl4 d", "l0\nl1 a\nl2 b\nl3 c\nl9", "Étion ç 中文字 naïve don't we'll 12 3½ <|endoftext|> _x́ İ\u001c!", "é" * 5000, prose(r, 6000)]
    for k in range(12):  # near copies, one or two words changed
        w = base.split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = f"new{r.random()}"
        texts.append(" ".join(w))
    texts += [prose(r, r.randrange(5, 80)) for _ in range(20)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}", 7, 7, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_byte_bpe_equals_the_library_and_decodes(docs, no_docs, rows):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe._ranks(path), special_tokens={})
    got, ids = by_id(byte_bpe.round_trip_digests(docs, path, pattern)), by_id(byte_bpe.encode(docs, path, pattern))
    raw = by_id(byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path))
    for i, t, *_ in rows:
        want = enc.encode_ordinary(t or "")
        assert ids[i]["ids"] == want and bytes(raw[i]["decoded"]) == (t or "").encode()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip_digests(no_docs, path, pattern).count() == 0


def test_exact_dedup(docs, no_docs, rows):
    from pyspark.sql import functions as F

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for out in (exact_dedup.deduplicate_split(docs, F.col("doc_id") % 2 == 0, shard_keys=10), exact_dedup.deduplicate(docs), exact_dedup.deduplicate(docs.filter("doc_id > 5"), docs.filter("doc_id <= 5"))):
        got = by_id(out)
        for t, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 50, 30_000])
def test_fuse_filter_has_no_false_negative_and_few_positives(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    f = exact_dedup.build_filter(keys)
    assert exact_dedup.screen(keys, *f).all()
    other = np.random.default_rng(99).integers(0, 2**64, 50_000, dtype=np.uint64)
    assert exact_dedup.screen(other, *f).mean() < 0.01
    assert n < 1000 or len(f[3]) < 1.6 * n


def test_substring_dedup(spark, docs, no_docs, rows):
    def want(pairs):
        counts, words = collections.Counter(), []
        for _, t in pairs:
            w = WORD.findall(t or "")
            words.append(w)
            counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
        for (i, _), w in zip(pairs, words):
            gone = {p for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
            kept = " ".join(x for p, x in enumerate(w) if p not in gone)
            yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept

    out = substring_dedup.remove_repeats(docs, with_text=True).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in out) == sorted(want([(i, t) for i, t, *_ in rows]))
    twice = spark.createDataFrame([(1, rows[5][1]), (1, rows[5][1]), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(twice).collect()) == [(0, 0), (1, 300), (1, 300)]
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_answers_of_another_block_are_refused():
    kind = substring_dedup.ANCHOR_KIND
    hashes = np.arange(1, 60, dtype="<u8").view(kind)
    rows = np.arange(59)
    answers = pa.Table.from_batches(list(substring_dedup._repeats(iter([substring_dedup._sent(0, hashes, 4), substring_dedup._sent(1, hashes[:9], 4)][:1]), kind)))
    assert len(substring_dedup._marks(hashes, rows, rows, answers, 4)[0]) == 0
    other = np.arange(2, 61, dtype="<u8").view(kind)  # as many, but not the same
    with pytest.raises(RuntimeError):
        substring_dedup._marks(other, rows, rows, answers, 4)


def test_the_cover_meets_every_shift():
    c = set(substring_dedup.COVER)
    assert {(a - b) % substring_dedup.PERIOD for a in c for b in c} == set(range(substring_dedup.PERIOD))


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(docs, no_docs, rows, shingle):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(hyperminhash.near_duplicates(docs, shingle))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)
    assert hyperminhash.near_duplicates(no_docs, shingle).count() == 0


IDS = {"shared and null": ("long", [1, 1, None, 2, None, 7, 3]), "texts": ("string", ["b", "b", None, "a", None, "x", "c"])}


@pytest.mark.parametrize("ids", IDS)
def test_ids_that_are_shared_null_or_texts(spark, ids):
    """Rows 0 and 4 have one text, 1, 2 and 3 near copies of another; 5 is null and 6 has no word."""
    kind, names = IDS[ids]
    r = random.Random(11)
    base, other = prose(r, 200), prose(r, 200)
    texts = [base, other, other + " end", other + " more", base.replace(" ", "\n"), None, " "]
    df = spark.createDataFrame(list(zip(names, texts, range(7))), f"doc_id {kind}, text string, row_key long").repartition(3)
    near = sorted(((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in hyperminhash.near_duplicates(df).collect()), key=str)
    first = min(n for n in (names[1], names[3]))
    want = [(names[i], 196 + (i in (2, 3)), names[0] if i in (0, 4) else first, names[i] == (names[0] if i in (0, 4) else first)) for i in range(5)]
    want += [(names[i], 0, names[i], True) for i in (5, 6)]
    assert near == sorted(want, key=str)
    exact = sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.deduplicate(df).collect()), key=str)
    alone = [(names[i], names[i], 1, True) for i in (1, 2, 3)]
    # null counts as empty and " " does not, as one space is left of white space
    assert exact == sorted([*alone, (names[0], names[0], 2, True), (None, names[0], 2, False), (names[5], names[5], 1, True), (names[6], names[6], 1, True)], key=str)
    assert {x["n_removed"] for x in line_dedup.remove_repeated_lines(df).collect()} == {0}
    encoded = byte_bpe.round_trip_digests(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    whole = [n if isinstance(n, int) else None for n in names]  # a text is no id there
    assert sorted((str(x["doc_id"]), x["decoded_sha256"]) for x in encoded) == sorted((str(n), sha(t)) for n, t in zip(whole, texts))
    kept = substring_dedup.remove_repeats(df).collect()
    assert sorted((str(x["doc_id"]), x["n_removed"]) for x in kept) == sorted((str(n), 200 if i < 5 else 0) for i, n in enumerate(names))


def test_a_component_of_null_ids_has_no_name(spark):
    r = random.Random(12)
    t = prose(r, 100)
    rows = hyperminhash.near_duplicates(spark.createDataFrame([(None, t), (None, t + " end"), (4, prose(r, 100))], "doc_id long, text string")).collect()
    assert sorted((str(x["doc_id"]), str(x["component_id"]), x["kept"]) for x in rows) == [("4", "4", True), ("None", "None", False), ("None", "None", False)]


def test_screening_is_dealt_out_without_a_snapshot(spark, monkeypatch):
    """However small the snapshot, no group of incoming digests is larger than a shard's share."""
    seen = spark.sparkContext.accumulator(0)
    groups = spark.sparkContext.accumulator(0)

    def counted(incoming, filters):
        seen.add(len(incoming))
        groups.add(bool(len(incoming)))
        return screened(incoming, filters)

    screened = exact_dedup._screened
    monkeypatch.setattr(exact_dedup, "_screened", counted)
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.deduplicate(docs.filter("doc_id >= 10"), docs.filter("doc_id < 10"), shard_keys=100).collect()
    assert sum(x["kept"] for x in out) == 900 and seen.value == 900 and groups.value >= 8


def test_quality_reference_of_other_languages_is_that_of_all(spark):
    r = random.Random(4)
    few = "the of and".split()
    good = [" ".join(r.choice(few) if k % 6 == 0 else "".join(r.choices("abcdefghij", k=6)) for k in range(120)) for _ in range(40)]
    bad = " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(120))
    out = by_id(quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)] + [(98, good[0], None), (99, bad, "xx")], "doc_id long, text string, lang string")))
    assert out[98]["kept"] and out[98]["common_distance"] < 0.2 and not out[99]["kept"] and out[99]["common_distance"] > quality.MAX_COMMON


def test_hyperminhash_screen_loses_no_similar_pair():
    """Pairs just at the threshold, whose estimates are lowest, all pass the screen."""
    r, lost, n = np.random.default_rng(3), 0, 0
    for size in (8, 20, 100, 1000):
        shared = int(np.ceil(size * 0.89))
        for _ in range(250):
            common = r.integers(0, 2**64, shared, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, r.integers(0, 2**64, size - shared, dtype=np.uint64)])) for _ in range(2))
            x = hyperminhash._registers([a, b])
            lost += bool(hyperminhash.estimate(x[:1], x[1:], np.array([size]), np.array([size]))[0] < 0.8 - hyperminhash.SLACK)
            n += 1
    assert lost == 0 and n == 1000


def test_hyperminhash_estimates_similarity():
    r = np.random.default_rng(1)
    for n, shared in ((400, 300), (60, 50), (20, 17)):
        errors = []
        for _ in range(30):
            common = r.integers(0, 2**64, shared, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, r.integers(0, 2**64, n - shared, dtype=np.uint64)])) for _ in range(2))
            x = hyperminhash._registers([a, b])
            errors.append(hyperminhash.estimate(x[:1], x[1:], np.array([n]), np.array([n]))[0] - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.04


def test_packing_places_every_id_once(docs, no_docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, path).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, total in [(p, len(want[i])) for i, p in pieces.items()] + [(s, sum(n for _, n in s)) for s in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == total
    assert set(pieces) == set(want)
    for s in sequences.values():
        n = sum(k for _, k in s)
        assert n <= 2048 and n & (n - 1) == 0
    assert packing.pack(no_docs, path).count() == 0


def test_packing_tokens_are_those_of_the_plain_tokenizer():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    pool = list("abcXYZ 012'’.,!?<|>_-") + [chr(c) for c in range(33)] + list("\x85\xa0éÉªº²½\xadßİı\u0301\u0308ﬁ中あ\u1160٣Ⅷ\u2028\u200b\u3000😀ǅΩÅ\ufeff\u0345ΣK")
    pool += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(24))) for _ in range(20_000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tok, got = Tokenizer.from_file(path), [x for b in packing._tokenise(iter([batch]), path) for x in b.column(2).to_pylist()]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_packing_of_repeated_null_and_odd_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None), ("7", "c <|endoftext|>"), ("7", "d"), ("x", "e")], "doc_id string, text string")
    out = [(x["doc_id"], x["doc_tokens"]) for x in packing.pack(rows, path).collect() if x["start"] == 0]
    assert sorted(out, key=str) == sorted([(None, 3), (None, 3), (None, 1), (7, 3), (7, 2), (None, 2)], key=str)


def test_packing_takes_the_nearest_documents_first():
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 8], [50, 51], [5, 6, 9], [60])]
    index = packing.Index(docs, np.ones(1 << 16, np.float32), 3.0)
    assert packing._Packer.scores_of(index, 0, np.array([False, True, True, True]))[0] == 2


def test_line_dedup(spark, docs, no_docs, rows):
    got = by_id(line_dedup.remove_repeated_lines(docs))
    assert got[12]["kept_text"] == rows[12][1] and (got[13]["n_removed"], got[13]["kept_text"]) == (3, "l0\nl9")
    assert (got[0]["n_lines"], got[0]["kept_text"]) == (1, "")
    twice = spark.createDataFrame([(1, "a\n\nb\nc"), (1, "a\n\nb\nc"), (None, "a\nb")], "doc_id long, text string")
    assert sorted(r["kept_text"] for r in line_dedup.remove_repeated_lines(twice).collect()) == ["", "a\n\nb\nc", "a\nb"]
    assert line_dedup.remove_repeated_lines(no_docs).count() == 0


def test_quality_counts_and_verdicts(spark, docs, no_docs, rows):
    got = by_id(quality.judge(docs))
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
    clean = "the cat sat of and in a house that is for it to see . " * 1
    r = random.Random(1)
    good = [" ".join(r.sample((clean + prose(r, 60, 9000)).split(), 60)) for _ in range(40)]
    bad = "###$$$ %%% ".join(["x"] * 80)
    out = by_id(quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, bad])], "doc_id long, text string, lang string")))
    assert all(out[i]["kept"] for i in range(40)) and not out[40]["kept"]
    assert quality.judge(no_docs).count() == 0


def test_quality_rejects_by_common_words_alone(spark):
    r = random.Random(4)
    few = "the of and to in a is that for it".split()
    # the share of common words that the test tables have
    good = [" ".join(r.choice(few) if k % 6 == 0 else "".join(r.choices("abcdefghij", k=6)) for k in range(120)) for _ in range(40)]
    bad = " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(120))
    out = by_id(quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, bad])], "doc_id long, text string, lang string")))
    assert all(out[i]["kept"] for i in range(40))
    assert not out[40]["kept"] and not out[40]["base_failed"] and out[40]["class_distance"] < quality.MAX_CLASSES


def test_perspectives(spark):
    turns = [(1, 0, "system", "be", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", "yo <|end|>", 1), (1, 2, "bob", "yo <|end|>", 2), (1, 3, None, None, 1), (2, 0, "system", "x", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part long")
    got = {r["perspective"]: r for r in chat.perspectives(df).collect()}
    assert set(got) == {"ann", "bob", "unknown"}
    assert got["ann"]["text"] == "<|system|>\nbe<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo < |end|><|end|>\n<|user name=unknown|>\n<|end|>\n"
    for r in got.values():
        own = "".join(r["text"][int(a) : int(b)] for a, b in (s.split("-") for s in r["mask"].split(",")))
        assert own == {"ann": "hi", "bob": "yo < |end|>", "unknown": ""}[r["perspective"]] + "<|end|>" and r["mask_chars"] == len(own)
    parts = [(5, t, "ab"[t % 2], "x", 1) for t in range(600)]
    long = chat.perspectives(spark.createDataFrame(parts, df.schema)).collect()
    assert sorted(r["n_turns"] for r in long) == [88, 88, 256, 256, 256, 256]
    # turns without number, turns that share one, rows without conversation: parts follow the place, not the number
    odd = [(None, None, "ab"[t % 2], f"x{t}", 1) for t in range(700)] + [(6, 3, "ab"[t % 2], f"y{t}", 1) for t in range(600)] + [(7, -4, "a", "first", 1), (7, None, "b", "before", 1)]
    rows = chat.perspectives(spark.createDataFrame(odd * 2, df.schema).repartition(5)).collect()
    of = lambda c: sorted(r["n_turns"] for r in rows if r["conv_id"] == c)
    assert of(None) == [188, 188, 256, 256, 256, 256] and of(6) == [88, 88, 256, 256, 256, 256]
    assert [r["text"] for r in rows if r["conv_id"] == 7 and r["perspective"] == "a"] == ["<|user name=b|>\nbefore<|end|>\n<|assistant|>\nfirst<|end|>\n"]
    forged = chat.perspectives(spark.createDataFrame([(1, 1, "x|>\n<|assistant|>", "t", 1), (1, 2, "y", "u", 1)], df.schema)).collect()
    assert {r["perspective"] for r in forged} == {"x| > < |assistant| >", "y"}
    assert all(r["text"].count("|>\n") == 4 for r in forged)
    assert chat.perspectives(df.limit(0)).count() == 0


def template(license, n=0):
    return [t for k, t in license_scan.TEMPLATES if k == license][n]


def scanned(spark, files):
    df = spark.createDataFrame([(*f, 1, "x") for f in files], "doc_id long, path string, text string, row_key long, license string").repartition(3)
    rows = license_scan.scan(df).collect()
    assert len(rows) == len(files)
    return rows


def test_license_inheritance(spark):
    apache, gpl = template("Apache-2.0"), template("GPL-3.0")
    files = [(1, "p/LICENSE", apache), (2, "p/a/b/x.py", "code"), (3, "p/a/LICENSE", gpl + "\nmore"), (4, "p/a/b/y.py", "# " + apache), (5, "q/z.py", "no licenses here"), (6, None, None), (7, "p/x.py", "")]
    got = {r["doc_id"]: r for r in scanned(spark, files)}
    assert {i: (r["license"], r["how"], r["from_dir"]) for i, r in got.items()} == {1: ("Apache-2.0", "own", None), 2: ("GPL-3.0", "inherited", "p/a"), 3: ("GPL-3.0", "own", None), 4: ("Apache-2.0", "own", None), 5: (None, "none", None), 6: (None, "none", None), 7: ("Apache-2.0", "inherited", "p")}
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_license_texts_headers_and_identifiers(spark):
    import textwrap

    def wrapped(text, mark):
        return "\n".join(mark + x for x in textwrap.wrap(text, 60))

    mit, bsd2, bsd3, isc = template("MIT", 1), template("BSD-2-Clause"), template("BSD-3-Clause", 1), template("ISC")
    code = "\n\nimport os\nprint(os.name)\n"
    files = [
        (1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(mit, "")),
        (2, "b/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"),
        (3, "c/LICENSE.txt", "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
        (4, "d/LICENSE", "Copyright (c) 2001, Someone\nAll rights reserved.\n\n" + wrapped(bsd3, "")),
        (5, "e/LICENSE", "Copyright (c) 2001, Someone\n\n" + wrapped(bsd2, "")),
        (6, "f/x.py", "# Copyright 2019 B\n#\n" + wrapped(template("Apache-2.0", 2), "# ") + code),
        (7, "f/y.c", "/*\n" + wrapped(template("GPL-2.0", 2), " * ") + "\n */" + code),
        (8, "f/z.c", "// " + wrapped(template("GPL-3.0", 3), "// ")[3:] + code),
        (9, "f/s.py", "#!/bin/python\n# SPDX-License-Identifier: MIT" + code),
        (10, "f/t.rs", "// SPDX-License-Identifier: GPL-2.0-or-later" + code),
        (11, "g/LICENSE", wrapped(isc, "")),
        (12, "h/readme", "The driver needs a license plate. He has the copyright of a song, and one licence to fish."),
        (13, "i/l.py", "-- " + wrapped(template("LGPL-2.1", 1), "-- ")[3:] + code),
    ]
    got = {r["doc_id"]: (r["license"], r["how"]) for r in scanned(spark, files)}
    want = ["MIT", "GPL-3.0", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MIT", "GPL-2.0-or-later", "ISC", None, "LGPL-2.1"]
    assert got == {i + 1: (w, "own" if w else "none") for i, w in enumerate(want)}


def test_license_expressions_stay_whole(spark):
    said = {"MIT OR Apache-2.0": "MIT OR Apache-2.0", "(MIT)": "MIT", "(MIT OR  GPL-2.0+) AND BSD-3-Clause */": "(MIT OR GPL-2.0+) AND BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0. Other": "GPL-2.0-only WITH Classpath-exception-2.0", "MIT or so": "MIT", "( LGPL-2.1-or-later AND\tISC )": "LGPL-2.1-or-later AND ISC", "(MIT": "MIT", "": None}
    got = {r["doc_id"]: r["license"] for r in scanned(spark, [(i, f"{i}/x.c", f"/* x */\n// SPDX-License-Identifier: {t}\ncode") for i, t in enumerate(said)])}
    assert got == dict(enumerate(said.values()))


def test_license_ties_repeated_rows_and_shared_ids(spark, tmp_path):
    mit, apache = template("MIT"), template("Apache-2.0")
    files = [(1, "p/LICENSE", mit), (1, "p/LICENSE", mit), (2, "p/NOTICE", apache), (3, "p/x", "none"), (4, "q/x", mit), (4, "q/x", "text"), (None, "p/q/r", None), (5, "y", apache + "\n" + mit), (6, "z", "long " * 50_000 + "\n" + mit)]
    rows = sorted([(r["doc_id"] or 0, r["license"] or "", r["how"], r["cosine"] or 0) for r in scanned(spark, files)])
    # at equal cosine the smaller name decides
    assert rows == [(0, "Apache-2.0", "inherited", 1.0), (1, "MIT", "own", 1.0), (1, "MIT", "own", 1.0), (2, "Apache-2.0", "own", 1.0), (3, "Apache-2.0", "inherited", 1.0), (4, "", "none", 0), (4, "MIT", "own", 1.0), (5, "Apache-2.0", "own", 1.0), (6, "MIT", "own", 1.0)]
    (tmp_path / "Own-1.0.txt").write_text("You may use this work under the licence of the house, version one")
    own = license_scan.read_templates(spark, str(tmp_path))
    got = license_scan.scan(spark.createDataFrame([(1, "a", "x\nUse this work under the licence of the house, version one")], "doc_id long, path string, text string"), own).collect()
    assert [(r["license"], r["how"]) for r in got] == [("Own-1.0", "own")]


def test_html_extraction(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SEQUENCES", 400)
    r = random.Random(4)
    pages, want = [], []
    for i in range(60):
        body = [prose(r, r.randrange(6, 60)) for _ in range(r.randrange(2, 9))]
        nav = "".join(f"<li><a href=x>{prose(r, 1)}</a></li>" for _ in range(5))
        article = f"<h1>{body[0]} &amp; co</h1>" + "".join(f"<p><b>{t}</b>  &copy;<br>" if k % 2 else f"<p>{t}</p>" for k, t in enumerate(body[1:]))
        pages.append((i, f"u{i}", f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>{nav}</ul></nav><div class=ad>{prose(r, 8)}</div><article>{article}</article><footer>&copy; {prose(r, 5)}</footer>" + ("</body></html>" if i % 2 else "")))
        want.append(" ".join([body[0] + " & co"] + [t + " ©" if k % 2 else t for k, t in enumerate(body[1:])]))
    pages += [(60, None, None), (61, "u", ""), (62, "u", "< <p")]
    got = {x["page_id"]: x for x in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i]["text"] for i in range(60)] == want and got[60]["text"] == got[61]["text"] == "" and got[3]["n_chars"] == len(want[3])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    model = html_extract.train_labeller([p[2] for p in pages[:60]])
    right = total = 0
    for i, p in enumerate(pages[:40]):
        page = html_extract.blocks_of(p[2])
        laid, y = html_extract.varied(page, html_extract.labelled(page), random.Random(100 + i))
        right += int((judged(model, laid) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.95


def judged(model, page):
    x, mask, _ = html_extract._padded([(html_extract._vectors(page), None)])
    return (model.scores(x, mask) > 0)[0]


LAYOUTS = ("sections", "divs", "table", "unclosed")


def laid_out(kind, i, r):
    """(html, texts of the article): the same kinds of texts in layouts that say less and less."""
    words = lambda n: " ".join("".join(r.choices("abdeiklmnoprstu", k=r.randint(2, 9))) for _ in range(n))
    sentence = lambda n: (words(n).capitalize() + ".")
    own = [words(r.randint(3, 9)).capitalize()] + [sentence(r.randint(12, 90)) for _ in range(r.randint(3, 9))]
    menu, ad, foot = [f"<a href=/{i}>{words(r.randint(1, 2))}</a>" for _ in range(6)], sentence(r.randint(5, 15)), "&copy; " + words(5)
    paragraphs = lambda tag, end=True: "".join(f"<{tag}>{t}" + (f"</{tag.split()[0]}>" if end else "") for t in own[1:])
    if kind == "sections":
        return f"<nav><ul>{''.join(f'<li>{m}</li>' for m in menu)}</ul></nav><div class=ad>{ad}</div><article><h1>{own[0]}</h1>{paragraphs('p')}</article><footer>{foot}</footer>", own
    if kind == "divs":
        return f"<body><div class=c1>{''.join(f'<div>{m}</div>' for m in menu)}</div><div class=c2><h1>{own[0]}</h1>{paragraphs('div class=c5')}</div><div class=c3>{ad}</div><div class=c4>{foot}</div>", own
    if kind == "table":
        return f"<body><table><tr><td colspan=2>{' | '.join(menu)}</td></tr><tr><td><h1>{own[0]}</h1>{paragraphs('p')}</td><td>{ad}</td></tr><tr><td>{foot}</td></tr></table>", own
    return f"<body><div class=q1><ul>{''.join(f'<li>{m}' for m in menu)}</ul></div><div class=q2><h1>{own[0]}</h1>{paragraphs('p', False)}</div><div class=q3>{ad}<div class=q4>{foot}", own


class EachAlone:
    """The same weights, but no state goes from one block to the next."""

    def __init__(self, model):
        self.model = model

    def scores(self, x, mask):
        return self.model.scores(x.reshape(-1, 1, x.shape[2]), mask.reshape(-1, 1)).reshape(mask.shape)


@pytest.mark.parametrize("learnt", ["sections", "divs"])
def test_html_labeller_on_layouts_that_it_was_not_shown(learnt):
    """Nine blocks of ten are right in every layout. Trained on sections, clearly fewer are without what the states carry along the
    page; trained on divs, a block's own vector does nearly as well there (3,270 of 3,286 right, and all with the states)."""
    r = random.Random(6)
    model = html_extract.train_labeller([laid_out(learnt, i, r)[0] for i in range(48)], [f"h{i % 12}" for i in range(48)])
    right, alone, total = {}, {}, {}
    for kind in LAYOUTS:
        for i in range(60):
            source, own = laid_out(kind, i, r)
            page = html_extract.blocks_of(source)
            for found, by in ((right, model), (alone, EachAlone(model))):
                found[kind] = found.get(kind, 0) + sum((b.text in own) == bool(k) for b, k in zip(page.blocks, judged(by, page)))
            total[kind] = total.get(kind, 0) + len(page.blocks)
    print(learnt, {k: (round(right[k] / n, 3), round(alone[k] / n, 3)) for k, n in total.items()})
    assert all(right[kind] / n >= 0.9 for kind, n in total.items()), (right, total)
    assert sum(right.values()) - sum(alone.values()) > (0.02 * sum(total.values()) if learnt == "sections" else 0)


def test_html_sample_is_distinct_spread_and_bounded(spark):
    pages = [(i, "http://a.b/1", "<p>same") for i in range(50)] + [(100 + i, f"http://h{i % 3}.c/{i}", f"<p>page {i}") for i in range(60)] + [(500, "http://z.z", "x" * 300_000), (501, None, "<p>no url"), (502, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_extract.training_sample(df, 8).collect()
    hosts = collections.Counter(x["host"] for x in rows)
    assert len(rows) == len({x["html"] for x in rows}) == 8 and hosts["a.b"] == 1 and len(hosts) == 5 and max(hosts.values()) == 2
    assert max(len(x["html"]) for x in rows) < 1000


def test_html_tags_with_loose_quotes_and_elements_without_text():
    said = lambda page: [b.text for b in html_extract.blocks_of(page).blocks]
    assert said("<p data-x=it's>Hello</p><p title=\"a > b\">there</p><p class = 'x > y' id=z\">you</p>") == ["Hello", "there", "you"]
    assert said("<p a=\"1\" b='2\" c=3>x</p>" + "<p" + " a='" * 3000 + ">y") != []  # in time that grows with the page
    assert said("<p>one<iframe src=q>no frames</iframe> two</p><noembed>old</noembed>") == ["one two"]


def test_html_repeated_rows_extra_columns_and_long_pages(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SEQUENCES", 200)
    r = random.Random(2)
    pages = [(i, "http://h/", laid_out("sections", i, r)[0], 1, "t") for i in range(20)]
    pages += [pages[3], pages[3], (50, None, "<article><p>" + "long text here</p><p>" * 30_000, 1, "t"), (51, None, None, 1, "t")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, h long, text string")).collect()
    assert len(got) == len(pages) and len({x["text"] for x in got if x["page_id"] == 3}) == 1
    by = {x["page_id"]: x for x in got}
    assert by[50]["n_chars"] == 15 * 30_000 - 1 and by[51]["text"] == "" and list(by[50].asDict()) == ["page_id", "url", "text", "n_chars"]
    empty = html_extract.extract(spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")).collect()
    assert [x["text"] for x in empty] == [""]


def test_html_paths_keep_their_containers(monkeypatch):
    rows = "".join(f"<tr><td>a{i}<td><p>b{i}" for i in range(100))
    deep = "<div>" * 300 + "inside"
    page = f"<html><body><nav><table>{rows}</table></nav><article><dl>{'<dt>k<dd>v' * 80}</dl>{deep}</article><footer>end</footer>"
    where = {b.text: b for b in html_extract.blocks_of(page).blocks}
    bits = lambda *tags: sum({1 << html_extract._element(t, "")[0][0] for t in tags})
    assert all(where[f"a{i}"].path == bits("html", "body", "nav", "table", "tr", "td") for i in range(100))
    assert all(where[f"{c}{i}"].aside for c in "ab" for i in range(100))
    assert where["inside"].path == bits("html", "body", "article", "div") and where["inside"].home and not where["inside"].aside
    assert where["k"].path == bits("html", "body", "article", "dl", "dt") and where["v"].path == bits("html", "body", "article", "dl", "dd")
    assert where["end"].path == bits("html", "body", "footer") and where["end"].aside and not where["end"].home
    got = []
    monkeypatch.setattr(html_extract.Labeller, "train", lambda self, data: got.extend(data))
    html_extract.train_labeller(["<article>" + "<p>x y</p>" * 1000 + "</article>"], copies=0)
    assert sum(len(v) for v, _ in got) == sum(len(y) for _, y in got) == 1000


def test_arrow_offsets_of_a_slice():
    from graphloom.llm import common

    a = pa.array(["ab c", None, "", "d\te"]).slice(1)
    data, off = common.text_buffers(a)
    part, starts, ends, row = common.word_spans(data, off, 0, 3)
    assert [bytes(part[s:e]) for s, e in zip(starts, ends)] == [b"d", b"e"] and row.tolist() == [2, 2]


def test_pipeline_stages_keep_their_promises(spark, rows, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    few = "the of and to in a is that for it".split()
    text = lambda n: " ".join(r.choice(few) if r.random() < 0.4 else f"w{r.randrange(9000)}" for _ in range(n))
    texts = [text(120) for _ in range(30)]
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " end", None, "short", "### $$$ " * 60]
    passage = text(60)
    texts += [f"{text(50)} {passage}", f"{passage} {text(50)}"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    everything = set(range(len(texts)))
    assert set(kept["quality_rules"]) == everything - {33, 34, 35}
    assert set(kept["exact_dedup"]) == everything - {33, 34, 35, 30, 31}
    assert set(kept["near_dedup"]) == everything - {33, 34, 35, 30, 31, 32}
    assert kept["substring_dedup"][36] == texts[36].removesuffix(" " + passage) and kept["substring_dedup"][5] == texts[5]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == set(kept["substring_dedup"])


def test_pipeline_stages_with_repeated_shared_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    few = "the of and to in a is that for it".split()
    text = lambda n: " ".join(r.choice(few) if r.random() < 0.4 else f"w{r.randrange(9000)}" for _ in range(n))
    t = [text(120) for _ in range(20)]
    rows = [(i, t[i]) for i in range(12)]
    rows += [(0, t[0]), (0, t[0])]  # a row three times
    rows += [(1, t[12])]  # two texts under one id
    rows += [(2, "short")]  # a rejected text under the id of a good one
    rows += [(None, t[13]), (None, t[14]), (None, t[14]), (None, t[3])]  # no id: two texts of their own, one twice, and a copy
    rows += [(50, t[15]), (None, t[15]), (40, t[15])]
    rows += [(3, t[16]), (3, t[16] + " end"), (None, t[17]), (None, t[17] + " end")]  # near copies
    passage = text(60)
    cut = [text(60), text(60)]
    rows += [(4, f"{cut[0]} {passage}"), (None, f"{passage} {cut[1]}")]
    r.shuffle(rows)
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    count = lambda pairs: collections.Counter(pairs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        kept[name] = count((x["doc_id"], x["text"]) for x in docs.collect())
    want = count(rows) - count([(2, "short")])
    assert kept["quality_rules"] == want
    want = count(set(want)) - count([(None, t[3]), (50, t[15]), (None, t[15])])
    assert kept["exact_dedup"] == want
    ends = lambda x: [(i, y) for i, y in kept["near_dedup"] if y in (t[x], t[x] + " end")]
    assert len(ends(16)) == len(ends(17)) == 1
    rest = lambda c: count({k: n for k, n in c.items() if not any(k[1].startswith(t[x]) for x in (16, 17))})
    assert rest(kept["near_dedup"]) == rest(want)
    want = kept["near_dedup"] - count([(4, f"{cut[0]} {passage}"), (None, f"{passage} {cut[1]}")]) + count([(4, cut[0]), (None, cut[1])])
    assert kept["substring_dedup"] == want
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed, ids = collections.Counter(), collections.Counter()
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed[x["doc_id"]] += x["length"]
    for (i, x), n in want.items():
        ids[i] += n * (len(tok.encode(x, add_special_tokens=False).ids) + 1)
    near_ids = {i for i in ids if i in (None, 3)}  # which near copy stays is free
    assert set(packed) == set(ids) and all(packed[i] == ids[i] for i in ids if i not in near_ids)


def divergence(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
    if not p.any() or not q.any():
        return 0.0
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt(max(0.0, (part(p) + part(q)) / 2))


def brute_quality(docs):
    """The rows that stay, by the rules said plainly."""
    facts = []
    for row in docs:
        text = row["text"] or ""
        words = WORD.findall(text)
        kind = row["lang"] if row["lang"] in quality.COMMON else "any"
        sets = ["[A-Z]", "[0-9]", "[#*$%&|<>]", r"[\x20\x09-\x0D]", r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]"]
        classes = [len(re.findall(c, text)) for c in sets]
        classes += [len(text) - sum(classes), len(text.encode()) - len(text)]
        low = collections.Counter(w.lower() for w in words)
        listed = lambda names: [low[w] for w in names] + [len(words) - sum(low[w] for w in names)]  # noqa: E731, B023
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {p for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        facts.append((row, kind, len(words), classes, listed(quality.COMMON.get(kind, quality.ANY)), listed(quality.ANY), len(again)))
    enough = [f for f in facts if f[2] >= quality.MIN_WORDS]
    total = lambda rows: np.sum(rows, axis=0) if len(rows) else [0]
    out = []
    for row, kind, n, classes, common, _, again in facts:
        peers = enough if kind == "any" else [f for f in enough if f[1] == kind]
        far = n >= quality.MIN_WORDS and (divergence(classes, total([f[3] for f in peers])) > quality.MAX_CLASSES or divergence(common, total([f[5 if kind == "any" else 4] for f in peers])) > quality.MAX_COMMON)
        if not (n < 10 or 100 * again > 20 * n or far):
            out.append(row)
    return out


def brute_pipeline(docs):
    """Rows after quality rules, exact, near and substring dedup, for unique ids."""
    stages, by = [brute_quality(docs)], {}
    for row in sorted(stages[-1], key=lambda r: r["doc_id"]):
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row["text"] or ""), row)
    stages.append(list(by.values()))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for row in stages[-1]:
        w = WORD.findall((row["text"] or "").translate(lower))
        sets[row["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[row["doc_id"]] = row["doc_id"]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    stages.append([row for row in stages[-1] if find(row["doc_id"]) == row["doc_id"]])
    counts, words = collections.Counter(), {}
    for row in stages[-1]:
        w = words[row["doc_id"]] = WORD.findall(row["text"] or "")
        counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    cut = []
    for row in stages[-1]:
        w = words[row["doc_id"]]
        gone = {p for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        cut.append(row | {"text": " ".join(x for p, x in enumerate(w) if p not in gone)} if gone else row)
    return [*stages, cut]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(170).collect()
    rows = [r.asDict() for r in docs]
    r = random.Random(21)
    for k in range(30):  # more copies, near copies and passages than so few rows have, and languages that no list has
        a, b = r.choice(rows[:170]), r.choice(rows[:170])
        text = [a["text"], f"{a['text']} end", f"{b['text']} {' '.join((a['text'] or '').split()[:50])}"][k % 3]
        rows.append(a | {"doc_id": 10_000 + k, "text": text, "lang": [a["lang"], None, "xx"][k % 3], "n_chars": len(text)})
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, docs = brute_pipeline(rows), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert {x["doc_id"]: x["text"] for x in docs.collect()} == {x["doc_id"]: x["text"] for x in expected}, name
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2]) and want[2] != want[3]
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[x["doc_id"]].append((x["start"], x["length"], x["ids_crc32"]))
    ids = {x["doc_id"]: tok.encode(x["text"] or "", add_special_tokens=False).ids + [1] for x in want[-1]}
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        assert sum(n for _, n, _ in parts) == len(ids[i])
        assert all(zlib.crc32(np.array(ids[i][a : a + n], "<u4").tobytes()) == c for a, n, c in parts)


def test_components_equal_union_find(spark):
    draw, n = random.Random(5), 200
    pairs = [(i, i + 1) for i in range(40)] + [(draw.randrange(50, 120), draw.randrange(50, 120)) for _ in range(45)] + [(130, x) for x in range(121, 160)] + [(7, 7)]
    names = list(range(n))
    draw.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in pairs]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = spark.createDataFrame([(i,) for i in range(n)], "cls long")
    got = hyperminhash.components(nodes, spark.createDataFrame(pairs, "a long, b long"))
    assert dict(map(tuple, got.collect())) == {i: find(i) for i in range(n)}
    none = hyperminhash.components(nodes, spark.createDataFrame([], "a long, b long"))
    assert all(c == k for k, c in none.collect())
