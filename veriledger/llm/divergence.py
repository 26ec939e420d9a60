"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes, and its histogram of common words, is compared with those of the languages by the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A document is kept if it passes the base rules and some
language is near in both. Texts too short for a histogram to say much are not judged by it (``min_chars``, ``min_words``).

Common words are learnt: of each language the COMMON most frequent, counted over all its rows. References are sums over all rows of a language (text and
lang not null). One row of sums for each language and COMMON words of it reach the driver.

How far is too far differs with length, so limits are learnt too (``limits``): for each band of lengths a high quantile of the rows that are known to be good text and pass the base
rules, in steps of a thousandth, and a margin. So a few wrong labels do not open a band, and limits settle as rows are added. A band with too few such rows for a quantile takes the
limits of the next shorter one, and the first ones take the fixed limits.

Defined results: null and empty texts have no words and fail the base rules; without any reference only the base rules judge; of equally frequent words the
smaller counts as more frequent; texts of any length are judged whole; repeated rows get equal results; further columns of docs play no part; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.llm.storage import materialise

#: Most frequent words of each language that make its histogram.
COMMON = 20
SYMBOLS = r"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "symbol", "other")
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.35, 0.6
MIN_CHARS, MIN_WORDS = 200, 40
#: Least words of the bands of lengths for which limits are learnt.
BANDS = (0, 40, 80, 160, 320, 1000)
#: The share of good rows, in per cent, that a limit holds before the margin; of how many at least; steps of a distance.
QUANTILE, LEAST_GOOD, STEPS = 98, 50, 1000
#: How much farther than that is too far.
MARGIN = 1.15
WINDOW = 8
_SPACE = " \t\n\x0b\f\r"


def _only(text: Column, unwanted: str) -> Column:
    """How many code points stay when runs of unwanted go."""
    return F.length(F.regexp_replace(text, unwanted, "")).cast("long")


def _split(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def common_words(docs: DataFrame, *, most: int = COMMON) -> list[str]:
    """The most frequent words (in lower case) of each language, together, in order. Ranked in salted parts first, so no task ranks a whole language."""
    words = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.explode(_split(F.lower("text"))).alias("w"))
    counted = words.groupBy("lang", "w").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "w"))
    few = counted.withColumn("r", rank("part")).where(F.col("r") <= most).withColumn("r", rank()).where(F.col("r") <= most)
    return sorted({r["w"] for r in few.select("w").collect()}, key=str.encode)


def _in_windows(words: Column, windows: Column) -> Column:
    """Words covered by windows that are found twice or more; windows has a hash for each start."""
    n = F.size(windows)
    return F.when(F.size(F.array_distinct(windows)) < n, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """docs with common: how often each word of the vocabulary is in _hits (sorted), from the lengths of its runs."""
    if not vocabulary:
        return docs.withColumn("common", F.array().cast("array<long>"))
    hits, firsts = F.col("_hits"), F.col("_firsts")
    starts = F.filter(F.transform(hits, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(hits, x["i"] - 1) != x["w"]))
    runs = F.transform(firsts, lambda x, j: F.struct(x["w"], (F.coalesce(F.get(firsts, j + 1)["i"], F.size(hits)) - x["i"]).cast("long")))
    found = docs.withColumn("_firsts", starts).withColumn("_runs", F.map_from_entries(runs))
    known = F.array(*[F.lit(w) for w in vocabulary])
    return found.withColumn("common", F.transform(known, lambda w: F.coalesce(F.try_element_at("_runs", w), F.lit(0).cast("long"))))


def features(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The columns of docs but text, and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars (counts by class), common (counts by word)."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*rest, text.alias("text")).withColumn("_words", _split(F.col("text")))
    words = F.col("_words")
    n = F.size(words)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hits = F.sort_array(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(vocabulary))) if vocabulary else F.array().cast("array<string>")
    b = a.select(
        *rest, "text", n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        windows.alias("_windows"), lines.alias("_lines"), hits.alias("_hits"),
    )
    c = b.withColumn("_sorted", _in_windows(words, F.col("_windows")))
    s = F.col("_sorted")
    size = F.size(s)
    twice = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < size - 1) & (F.get(s, j + 1)["h"] == x["h"])))
    d = c.withColumn("_at", F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    at = F.col("_at")
    steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda y, x: F.least(y - x, F.lit(WINDOW)))
    repeat = F.when(at.isNotNull(), F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda acc, x: acc + x)).otherwise(F.lit(0).cast("long"))
    symbols = _only(F.col("text"), f"[^{SYMBOLS}]+")
    letters, upper, digits = _only(F.col("text"), r"\P{L}+"), _only(F.col("text"), r"\P{Lu}+"), _only(F.col("text"), r"\P{Nd}+")
    e = _counted(d, vocabulary).select(
        *rest, "n_words", "word_chars", symbols.alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
        letters.alias("_letters"), upper.alias("_upper"), digits.alias("_digits"), "common",
    )
    chars = F.array(F.col("_letters") - F.col("_upper"), F.col("_upper"), F.col("_digits"), F.col("n_symbols"), F.greatest(F.col("word_chars") - F.col("_letters") - F.col("_digits") - F.col("n_symbols"), F.lit(0).cast("long")))
    return e.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), "common")


def references(featured: DataFrame, n_common: int) -> dict[str, tuple[list[float], list[float]]]:
    """For each language that has rows: shares of the character classes, and of the common words with all other words last."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    rows = featured.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect()
    out = {}
    for r in rows:
        chars = [r[f"c{i}"] for i in range(len(CLASSES))]
        words = [r[f"w{i}"] for i in range(n_common)]
        if r["n"] and sum(chars):
            out[r["lang"]] = [x / sum(chars) for x in chars], [x / r["n"] for x in [*words, r["n"] - sum(words)]]
    return out


def distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of shares and fixed shares."""
    other = F.array(*[F.lit(float(x)) for x in q])

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, other, lambda x, y: (part(x, y) + part(y, x)) / 2), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def limits(judged: DataFrame, *, margin: float = MARGIN, quantile: int = QUANTILE, least: int = LEAST_GOOD) -> dict[int, tuple[float, float]]:
    """For each band the most char_distance and word_distance, learnt from rows of judge() that are good text.

    Rows are counted by band and step of distance, so what reaches the driver has a bound: bands x 2 x (STEPS + 1) counts.
    """
    band = F.greatest(*[F.when(F.col("n_words") >= b, b).otherwise(0) for b in BANDS])
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.ceil(F.col(c) * STEPS).alias("step")) for i, c in enumerate(("char_distance", "word_distance"))])).alias("s")
    counted = judged.where("NOT base_failed").select(band.alias("band"), steps).select("band", "s.*").where("step IS NOT NULL").groupBy("band", "which", "step").agg(F.count("*").alias("n"))
    found: dict[tuple, list] = {}
    for r in sorted(counted.collect()):
        found.setdefault((r["band"], r["which"]), []).append((r["step"], r["n"]))

    def limit(steps: list[tuple[int, int]], otherwise: float) -> float:
        total, so_far = sum(n for _, n in steps), 0
        if total < least:
            return otherwise
        for step, n in steps:
            so_far += n
            if 100 * so_far >= quantile * total:
                return step / STEPS * margin
        return otherwise

    out, last = {}, (MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE)
    for b in BANDS:
        out[b] = last = tuple(limit(found.get((b, i), []), y) for i, y in enumerate(last))
    return out


def judge(featured: DataFrame, reference: dict, *, learnt: dict[int, tuple[float, float]] | None = None, most_char_distance: float = MOST_CHAR_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """featured with char_distance and word_distance (to the nearest language; null if not judged), base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = featured.withColumn("base_failed", failed).withColumn("_n", n_chars)
    shares = shares.withColumn("_chars", F.transform("chars", lambda x: x / F.greatest("_n", F.lit(1).cast("long"))))
    hits = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = shares.withColumn("_words", F.transform(F.concat("common", F.array(F.col("n_words") - hits)), lambda x: x / F.greatest("n_words", F.lit(1).cast("long"))))
    names = sorted(reference)

    def nearest(column: str, which: int, judged: Column) -> Column:
        found = [distance(F.col(column), reference[n][which]) for n in names]
        return F.when(judged, F.round(found[0] if len(found) == 1 else F.least(*found), 9)) if found else F.lit(None).cast("double")

    out = shares.withColumn("char_distance", nearest("_chars", 0, F.col("_n") >= min_chars)).withColumn("word_distance", nearest("_words", 1, F.col("n_words") >= min_words))
    most_char, most_word = F.lit(most_char_distance), F.lit(most_word_distance)
    for band, (char, word) in sorted((learnt or {}).items()):
        most_char, most_word = (F.when(F.col("n_words") >= band, x).otherwise(y) for x, y in ((char, most_char), (word, most_word)))
    far = (F.coalesce("char_distance", F.lit(0.0)) > most_char) | (F.coalesce("word_distance", F.lit(0.0)) > most_word)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("_n", "_chars", "_words")


def assess(docs: DataFrame, *, good: DataFrame | None = None, margin: float = MARGIN, **options) -> DataFrame:
    """doc_id, features, distances, base_failed and kept of every row; good: doc_id of good texts, to learn limits from. Without, the fixed limits judge."""
    docs = docs.select("doc_id", "text", "lang")
    vocabulary = common_words(docs)
    featured = materialise(features(docs, vocabulary))
    reference = references(featured, len(vocabulary))
    if good is not None:
        own = judge(featured.join(good.select("doc_id").distinct(), "doc_id", "left_semi"), reference, **options)
        options["learnt"] = limits(own, margin=margin)
    return judge(featured, reference, **options)


def op8_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    shown = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")]
    return assess(docs, good=labels.where("quality = 1")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *shown)


QUERIES = {"op8_distribution_divergence": op8_distribution_divergence}


def _sql() -> str:
    share = "(CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (p + q)) ELSE 0 END)"
    js = f"sqrt(greatest(0, sum(({share.format('p')} + {share.format('q')}) / 2)))"

    def nearest(name, counts, total):
        return f"""{name}_l AS (SELECT k, lang, {total} AS total, unnest(range(1, len({counts}) + 1)) AS i, unnest({counts}) AS c FROM f),
{name}_q AS (SELECT lang, i, sum(c) / sum(total) AS q FROM {name}_l WHERE lang IS NOT NULL GROUP BY lang, i HAVING sum(total) > 0),
{name}_d AS (SELECT k, min(d) AS d FROM (SELECT k, x.lang, {js} AS d FROM (SELECT {name}_l.k, {name}_q.lang, c / greatest(total, 1) AS p, q FROM {name}_l JOIN {name}_q USING (i)) x GROUP BY k, x.lang) GROUP BY k)"""

    bands = ", ".join(f"({b})" for b in BANDS)
    held = f"""l{{m}} AS (SELECT band, min(step) AS {{m}} FROM (SELECT band, s{{m}} AS step, sum(count(*)) OVER (PARTITION BY band ORDER BY s{{m}}) AS n, sum(count(*)) OVER (PARTITION BY band) AS total
  FROM st WHERE s{{m}} IS NOT NULL GROUP BY band, s{{m}}) WHERE total >= {LEAST_GOOD} AND 100 * n >= {QUANTILE} * total GROUP BY band)"""
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
voc AS (SELECT DISTINCT v FROM (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, v) AS r
  FROM (SELECT lang, lower(unnest(w)) AS v FROM d WHERE lang IS NOT NULL) GROUP BY lang, v) WHERE r <= {COMMON}),
g AS (SELECT k, i, list_slice(w, i, i + 7) AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
rw AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS c FROM g) WHERE c > 1) GROUP BY k),
ln AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
e AS (SELECT d.k, doc_id, lang, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '\PL+', '', 'g')) AS le, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS up, length(regexp_replace(text, '\P{{Nd}}+', '', 'g')) AS di,
  list_transform(coalesce((SELECT list(v ORDER BY v) FROM voc), []), lambda v: len(list_filter(w, lambda x: lower(x) = v))) AS common FROM d LEFT JOIN rw USING (k) LEFT JOIN ln USING (k)),
f AS (SELECT *, [le - up, up, di, n_symbols, greatest(word_chars - le - di - n_symbols, 0)] AS chars, list_append(common, n_words - list_sum(common)) AS every, list_sum(chars) AS n_chars FROM e),
{nearest("ch", "chars", "n_chars")},
{nearest("wo", "every", "n_words")},
v AS (SELECT f.*, CASE WHEN n_chars >= {MIN_CHARS} THEN round(ch_d.d, 9) END AS cd, CASE WHEN n_words >= {MIN_WORDS} THEN round(wo_d.d, 9) END AS wd, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM f LEFT JOIN ch_d USING (k) LEFT JOIN wo_d USING (k)),
x AS (SELECT *, (SELECT max(b) FROM (VALUES {bands}) AS bs(b) WHERE b <= n_words) AS band FROM v),
good AS (SELECT * FROM x SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE NOT base_failed),
st AS (SELECT band, ceil(cd * {STEPS}) AS sc, ceil(wd * {STEPS}) AS so FROM good),
{held.format(m="c")},
{held.format(m="o")},
lim AS (SELECT b, coalesce(last_value(c IGNORE NULLS) OVER s / {STEPS}::DOUBLE * {MARGIN}::DOUBLE, {MOST_CHAR_DISTANCE}) AS lc, coalesce(last_value(o IGNORE NULLS) OVER s / {STEPS}::DOUBLE * {MARGIN}::DOUBLE, {MOST_WORD_DISTANCE}) AS lo
  FROM (VALUES {bands}) AS bs(b) LEFT JOIN lc ON lc.band = b LEFT JOIN lo ON lo.band = b WINDOW s AS (ORDER BY b ROWS UNBOUNDED PRECEDING))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(cd, 0) > lc OR coalesce(wd, 0) > lo) AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM x JOIN lim ON b = band"""


SQL = {"op8_distribution_divergence": _sql()}
