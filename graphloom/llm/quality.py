"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of its language's most common words are compared to the references of
its language by the Jensen-Shannon distance (base 2, so in [0, 1]). The references are the sums of the histograms of all
documents of the language that have MIN_WORDS words. Shorter documents are not judged by divergence. Base rules come first:
a document of fewer than 10 words, or with more than a fifth of its words in repeated 5-word windows, fails.

Inputs: null text counts as empty; a null or unlisted language is judged against the reference of all documents, by the
words of ANY, which are counted in every one; a long text is judged whole; equal rows give equal results, null and shared
doc_ids one row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 40
#: Distances above which a document is rejected. A text without any common word is 0.29 to 0.31 from the references of the
#: test tables; no document labelled as good there is further than 0.271.
MAX_CLASSES, MAX_COMMON = 0.27, 0.28
#: Frequent function words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it"),
    "fr": ("de", "la", "le", "les", "et", "des", "que", "en", "un", "une"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "las", "un", "para"),
}
ANY = ("the", "of", "and", "de", "la", "que", "en", "der", "die", "und")
#: Character classes that are counted; lower case and all else of one byte is the rest, and further bytes of code points
#: count as a class of their own.
CLASSES = ("[A-Z]+", "[0-9]+", "[#*$%&|<>]+", C.SPACE, "[!-/:-@\\[-`{-~&&[^#*$%&|<>]]+")


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the text has twice or more, the first included."""

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(w[i + j] for j in range(5))))

        def covered(h: Column) -> Column:
            ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def marked(s: Column) -> Column:
                last = F.size(s) - 1
                dup = F.filter(F.sequence(F.lit(0), last), lambda k: (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"]) & (k > 0) | (s[F.least(k + 1, last)]["h"] == s[k]["h"]) & (k < last))
                places = F.array_sort(F.transform(dup, lambda k: s[k]["i"]))
                add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["at"])).alias("n"), p.alias("at"))
                return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at")), add, lambda acc: acc["n"])

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, marked))

        return F.when(F.size(w) < 6, F.lit(0)).otherwise(_let(hashes, covered))

    return _let(words, of)


def _counts(text: Column, lang: Column) -> dict[str, Column]:
    """The base counts and both histograms."""
    words, total = C.words_column(text), F.length(text)
    gone = [total - F.length(F.regexp_replace(text, c, "")) for c in CLASSES]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    listed = F.coalesce(*(F.when(lang == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()), F.array(*map(F.lit, ANY)))
    own = [listed[i] for i in range(len(ANY))]
    # every word between two spaces of its own, so that taking a word out tells how often it is there
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), C.SPACE, "  "), F.lit(" "))
    # of which only those stay that some list has
    some = "|".join(sorted({w for v in (*COMMON.values(), ANY) for w in v}))
    spaced = F.regexp_replace(spaced, f" (?!(?:{some}) )[^ ]+ ", "")

    def counts(spaced: Column, those: list[Column]) -> Column:
        left = lambda w: F.octet_length(F.replace(spaced, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
        return F.array(*(((F.octet_length(spaced) - left(w)) / (F.octet_length(w) + 2)).cast("double") for w in those))

    common = _let(spaced, lambda s: F.struct(counts(s, own).alias("own"), counts(s, list(map(F.lit, ANY))).alias("any")))
    # apart from the above: nested in one lambda, both take twice as long
    facts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    return {
        "facts": facts,
        "common": common,
        "gone": F.array(*gone),
        "total": total,
        "wide": F.octet_length(text) - total,
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(F.lit(0.0))

    def of(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a / sums["p"], b / sums["q"]) + part(b / sums["q"], a / sums["p"]))
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))).otherwise(F.lit(0.0))

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), of)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and the histograms `classes` and `common` of each row; `kind` is its reference."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit("any"))
    rows = docs.select("doc_id", kind.alias("kind"), *(v.alias(k) for k, v in _counts(text, kind).items()))
    gone = F.col("gone")
    rest = F.col("total") - sum((gone[i] for i in range(1, len(CLASSES))), gone[0])
    classes = F.array(*(x.cast("double") for x in [*(gone[i] for i in range(len(CLASSES))), rest, F.col("wide")]))
    # the words of the list, and all others
    with_rest = lambda c: F.concat(F.col(c), F.array(F.col("facts.n_words") - F.aggregate(c, F.lit(0.0), lambda a, b: a + b)))
    return rows.select("doc_id", "kind", F.col("facts.n_words").alias("n_words"), (F.col("total") - gone[3]).cast("long").alias("word_chars"), gone[2].cast("long").alias("n_symbols"), "n_dup_lines", F.col("facts.n_repeat_words").alias("n_repeat_words"), classes.alias("classes"), with_rest("common.own").alias("common"), with_rest("common.any").alias("common_any"))


def references(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(ref, ref_classes, ref_common): for each listed language, and "any" for all documents: five rows at most."""
    use = rows.filter(F.col("n_words") >= min_words).select("kind", "classes", "common", "common_any")
    sums = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n)))
    by = use.groupBy("kind").agg(sums("classes", len(CLASSES) + 2).alias("c"), sums("common", len(ANY) + 1).alias("w"), sums("common_any", len(ANY) + 1).alias("a"))
    everything = by.agg(sums("c", len(CLASSES) + 2).alias("ref_classes"), sums("a", len(ANY) + 1).alias("ref_common")).select(F.lit("any").alias("ref"), "ref_classes", "ref_common")
    return by.filter("kind <> 'any'").select(F.col("kind").alias("ref"), F.col("c").alias("ref_classes"), F.col("w").alias("ref_common")).unionByName(everything)


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_classes: float = MAX_CLASSES, max_common: float = MAX_COMMON) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, common_distance."""
    rows = C.written(measured(docs), "histograms")  # some 200 bytes a document, read twice
    refs = F.broadcast(references(rows, min_words))  # bounded: a row for each language of COMMON, and one
    out = rows.join(refs, rows["kind"] == refs["ref"], "left")
    enough = F.col("n_words") >= min_words
    far = lambda a, b: F.round(F.when(enough, F.coalesce(_distance(F.col(a), F.col(b)), F.lit(0.0))).otherwise(F.lit(0.0)), 6) + 0.0
    out = out.withColumns({"class_distance": far("classes", "ref_classes"), "common_distance": far("common", "ref_common")})
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    kept = ~failed & (F.col("class_distance") <= max_classes) & (F.col("common_distance") <= max_common)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "class_distance", "common_distance")


def _oracle() -> str:
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
    any_list = f"[{', '.join(repr(w) for w in ANY)}]"
    n = len(ANY) + 1
    spaces, symbols = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
    classes = ["[A-Z]", "[0-9]", symbols, spaces, r"[!\"''()+,\-./:;=?@\[\\\]^_`{}~]"]
    count = ", ".join(f"(length(text) - length(regexp_replace(text, '{c}+', '', 'g')))::DOUBLE" for c in classes)
    js = lambda p, q: f"(SELECT sqrt(greatest(0, coalesce(sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2, 0))) FROM (SELECT unnest({p}) / nullif(list_sum({p}), 0) AS a, unnest({q}) / nullif(list_sum({q}), 0) AS b))"
    sums = lambda c, k: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, k + 1)) + "]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'any' END AS kind FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(text, '{spaces}+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
      CASE kind {lists} ELSE {any_list} END AS cw, [{count}] AS g FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM b)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1) GROUP BY doc_id),
m AS (SELECT b.doc_id, kind, len(w)::BIGINT AS n_words, (length(text) - g[4])::BIGINT AS word_chars, g[3]::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
      list_concat(g, [length(text) - list_sum(g), (strlen(text) - length(text))::DOUBLE]) AS c,
      list_concat(list_transform(cw, lambda x: len(list_filter(w, lambda y: lower(y) = x))::DOUBLE), [len(list_filter(w, lambda y: NOT list_contains(cw, lower(y))))::DOUBLE]) AS h,
      list_concat(list_transform({any_list}, lambda x: len(list_filter(w, lambda y: lower(y) = x))::DOUBLE), [len(list_filter(w, lambda y: NOT list_contains({any_list}, lower(y))))::DOUBLE]) AS ha
      FROM b LEFT JOIN rep USING (doc_id)),
r AS (SELECT kind, {sums("c", len(CLASSES) + 2)} AS rc, {sums("h", n)} AS rh, {sums("ha", n)} AS ra FROM m WHERE n_words >= {MIN_WORDS} GROUP BY kind),
refs AS (SELECT kind, rc, rh FROM r WHERE kind <> 'any' UNION ALL SELECT 'any', {sums("rc", len(CLASSES) + 2)}, {sums("ra", n)} FROM r),
j AS (SELECT m.*, CASE WHEN n_words >= {MIN_WORDS} THEN round({js("c", "rc")}, 6) ELSE 0.0 END + 0.0 AS class_distance, CASE WHEN n_words >= {MIN_WORDS} THEN round({js("h", "rh")}, 6) ELSE 0.0 END + 0.0 AS common_distance FROM m LEFT JOIN refs USING (kind)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND class_distance <= {MAX_CLASSES} AND common_distance <= {MAX_COMMON} AS kept, class_distance, common_distance FROM f"""


ORACLE_SQL = _oracle()
