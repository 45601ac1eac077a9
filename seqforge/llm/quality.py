"""Quality rules by distribution divergence (DataFrame functions only).

A document's character-class histogram and its histogram of common words are
compared with references of its language by Jensen-Shannon distance (base 2,
0 to 1).  The references are sums over all documents of the language; common
words are those with at least ``min_share`` of its words (so 1 / min_share at
most).  Documents or languages below minimum lengths are not judged by a
distance that their length cannot support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm import common as C

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
BLANKS = " \t\n\x0b\f\r"
#: Character classes beside a-z, counted in what is left without a-z; all
#: remaining characters are "other".
IN_REST = {"upper": r"[A-Z]+", "digit": r"[0-9]+", "punct": r"[!-/:-@\[-`{-~]+", "space": SPACES}
CLASSES = ["lower", *IN_REST, "other"]
#: Words that are not common are counted in two bins, up to so many characters and over.
SHORT = 5
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.42
MIN_CHARS, MIN_WORDS = 100, 40
MIN_SHARE, MIN_REFERENCE_WORDS = 0.005, 1000
#: Copies of a language's sums that its words are dealt to.
SALT = 64
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
         "class_distance", "word_distance", "kept"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: a plain column that lambdas refer
    to would be computed anew in each of their steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def short(word: Column) -> Column:
    return F.length(word) <= SHORT


def lang_of(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col), F.lit("")).alias("ref_lang")


def repeat_hashes(words: Column) -> Column:
    """Hashes of the 5-word windows of a list of words."""
    return let(words, lambda w: F.when(F.size(w) < 6, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))))


def repeated_words(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: windows are put in
    the order of their hashes, those equal to a neighbour go back into text
    order, and each adds the words that the next one does not cover."""
    like = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    at = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(at, lambda s: F.filter(s, lambda x, k: like(s, k - 1, x) | like(s, k + 1, x)))
    return let(F.array_sort(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(
        F.transform(p, lambda v, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - v, F.lit(5)))), F.lit(0), lambda a, x: a + x))


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance of two equally long lists of shares."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    total = sum((part(x, y) + part(y, x) for x, y in zip(p, q)), F.lit(0.0))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def array_js_distance(p: Column, q: Column) -> Column:
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def common_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """One row per language: ref_lang, ref_words (its words), common (words
    with ``min_share`` of them, by falling count) and shares (theirs, then those
    of the other short and the other long words)."""
    words = words_of(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    counts = docs.select(lang_of(lang_col), F.explode(words).alias("word")).groupBy("ref_lang", "word").agg(F.count("*").alias("n"))
    counts = C.stored(counts, "word-counts")
    sums = counts.groupBy("ref_lang").agg(
        F.sum("n").alias("ref_words"), F.sum(F.when(short(F.col("word")), F.col("n")).otherwise(0)).alias("ref_short"))
    # each language's sums in copies by salt: the words of a large one lie in many tasks
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALT)).cast("int"))
    common = counts.join(sums, ["ref_lang", "salt"]).filter(F.col("n") >= F.col("ref_words") * min_share) \
        .groupBy("ref_lang", "ref_words", "ref_short").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("top"))
    top = F.transform("top", lambda x: -x["n"] / F.col("ref_words"))
    listed = lambda top: F.aggregate(top, F.lit(0).cast("long"), lambda a, x: a - x["n"])
    in_short = listed(F.filter("top", lambda x: short(x["word"])))
    others = [F.col("ref_short") - in_short, F.col("ref_words") - F.col("ref_short") - listed(F.col("top")) + in_short]
    return C.stored(common.select("ref_lang", "ref_words", F.col("top.word").alias("common"), F.concat(
        top, F.array(*[x / F.col("ref_words") for x in others])).alias("shares")), "common-words")


def features(docs: DataFrame, common: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``docs`` with the base counts, the class counts (_<class>), the counts
    of the language's common words and of its other short and
    other long words (_hist)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.join(common.withColumnRenamed("ref_lang", "_lang"), lang_of(lang_col) == F.col("_lang"), "left").drop("_lang")
    out = out.withColumn("_rest", F.regexp_replace(text, r"[a-z]+", "")).withColumn("_w", words_of(text))
    out = out.withColumn("_g", repeat_hashes(F.col("_w")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rest = F.col("_rest")
    listed = F.coalesce("common", F.array().cast("array<string>"))
    hist = let(F.transform("_w", lambda w: F.lower(w)), lambda ws: let(
        F.filter(ws, lambda w: F.array_contains(F.col("common"), w)), lambda own: let(
            F.size(F.filter(ws, short)) - F.size(F.filter(own, short)), lambda brief: F.concat(
                F.transform(listed, lambda c: F.size(F.filter(own, lambda w: w == c)).cast("double")),
                F.array(brief.cast("double"), (F.size(ws) - F.size(own) - brief).cast("double"))))))
    size = {k: (F.length(rest) - F.length(F.regexp_replace(rest, p, ""))).cast("double") for k, p in IN_REST.items()}
    out = out.select(
        *docs.columns, "ref_words", "shares", hist.alias("_hist"),
        (F.length(text) - F.length(rest)).cast("double").alias("_lower"), *[v.alias(f"_{k}") for k, v in size.items()],
        F.length(text).cast("double").alias("_all"), F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(rest, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(repeated_words(F.col("_g"))).cast("long").alias("n_repeat_words"))
    known = sum((F.col(f"_{k}") for k in CLASSES[:-1]), F.lit(0.0))
    return out.withColumn("_other", F.col("_all") - known)


def quality_rules(docs: DataFrame, keep_text: bool = True, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with the base counts, both distances and ``kept``.

    ``kept`` is false if base_failed (under 10 words, or over a fifth of the
    words in repeated 5-word windows), if class_distance is over
    MAX_CLASS_DISTANCE (texts of MIN_CHARS characters and more) or if
    word_distance is over MAX_WORD_DISTANCE (texts of MIN_WORDS words,
    languages of MIN_REFERENCE_WORDS, and more); a distance that is not judged
    is null.  A null text is empty; null languages are one language; input
    columns named as the added ones are replaced; repeated rows are judged
    alike.  An empty table gives an empty result.

    With ``keep_text`` the texts are read once more for the class references
    and never written; without it the counts are written to the shared folder.
    """
    docs = C.without(docs, ADDED)
    names = [c for c in docs.columns if keep_text or c != text_col]
    own = features(docs, common_words(docs, lang_col, text_col), lang_col, text_col)
    if not keep_text:
        own = C.stored(own.drop(text_col), "quality-counts")
    sums = own.groupBy(lang_of(lang_col)).agg(*[F.sum(f"_{k}").alias(f"ref_{k}") for k in CLASSES])
    every = sum((F.col(f"ref_{k}") for k in CLASSES), F.lit(0.0))
    sums = C.stored(sums.select("ref_lang", *[(F.col(f"ref_{k}") / every).alias(f"ref_{k}") for k in CLASSES]), "class-shares")
    out = own.join(sums, lang_of(lang_col) == F.col("ref_lang"), "left")
    out = out.withColumn("word_chars", (F.col("_all") - F.col("_space")).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("class_distance", F.when(F.col("_all") >= MIN_CHARS, js_distance(
        [F.col(f"_{k}") / F.col("_all") for k in CLASSES], [F.col(f"ref_{k}") for k in CLASSES])))
    in_hist = F.aggregate("_hist", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("word_distance", F.when((in_hist >= MIN_WORDS) & (F.col("ref_words") >= MIN_REFERENCE_WORDS), let(
        in_hist, lambda n: array_js_distance(F.transform("_hist", lambda x: x / n), F.col("shares")))))
    fits = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    # one expression: a conjunction would be taken apart by a filter on it, and its
    # first part computed from the text below the join, once for each mention
    kept = F.forall(F.array(~F.col("base_failed"), fits), lambda x: x)
    return out.withColumn("kept", kept).select(*names, *ADDED)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return quality_rules(docs.select("doc_id", "lang", "text"), keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that pass."""
    return quality_rules(docs).filter("kept").select(*docs.columns)
