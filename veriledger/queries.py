"""Registered queries over the test tables, and the SQL for the same rows.

The event table serves as a ledger: consecutive purchasers are transfers, signup events give devices.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.functions.scalars import micros
from veriledger.operators import audit_chain, chains, evaluation, retrieval, signals, validation, verdicts
from veriledger.registry import query
from veriledger.sources import corpus as corpora
from veriledger.sources import ledger as ledgers
from veriledger.sources import lookup
from veriledger.storage import materialise

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


_T = """t AS (SELECT src, dst, ts, value FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, ts, value, event_id FROM events WHERE event_type = 'purchase')
  WHERE dst IS NOT NULL AND src <> dst AND value > 0 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, event_id DESC) = 1)"""
_D = """d AS (SELECT DISTINCT account_id, device_id FROM (
  SELECT user_id AS account_id, concat('D', json_extract_string(props, '$.k'), '-', CAST(hour(ts) AS VARCHAR)) AS device_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup') WHERE rn <= 3)"""
_A = "a AS (SELECT DISTINCT user_id AS account_id FROM events WHERE user_id IS NOT NULL)"
_SHARED = """sd AS (SELECT a.account_id, coalesce(s.n, 0) AS shared_device_account_count FROM a LEFT JOIN (
  SELECT x.account_id, count(DISTINCT y.account_id) AS n FROM d x JOIN d y ON x.device_id = y.device_id AND x.account_id <> y.account_id GROUP BY 1) s USING (account_id))"""
_CC = """u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM t),
tri AS (SELECT p.x AS a, p.y AS b, q.y AS c FROM u p JOIN u q ON p.y = q.x JOIN u r ON r.x = p.x AND r.y = q.y),
tv AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY v),
dv AS (SELECT v, count(*) AS k FROM (SELECT x AS v FROM u UNION ALL SELECT y FROM u) GROUP BY v),
cc AS (SELECT a.account_id, CASE WHEN coalesce(dv.k, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(tv.n, 0) / (dv.k * (dv.k - 1)) END AS local_clustering_coefficient
  FROM a LEFT JOIN dv ON dv.v = a.account_id LEFT JOIN tv ON tv.v = a.account_id)"""
_P = """p AS (SELECT src AS s, dst AS e, epoch_us(ts) AS us, CAST(NULL AS DOUBLE) AS g, [src, dst] AS vis, 1 AS k FROM t
  UNION ALL SELECT p.s, t.dst, epoch_us(t.ts), coalesce(least(p.g, (epoch_us(t.ts) - p.us) / 1e6), (epoch_us(t.ts) - p.us) / 1e6), list_append(p.vis, t.dst), p.k + 1
  FROM p JOIN t ON t.src = p.e WHERE p.k < 6 AND epoch_us(t.ts) - p.us BETWEEN 0 AND 7200000000 AND NOT list_contains(p.vis, t.dst))"""
_FB = """f AS (SELECT s AS account_id, k AS f, min(g) AS fg FROM (SELECT *, max(k) OVER (PARTITION BY s) AS mk FROM p) WHERE k = mk GROUP BY 1, 2),
b AS (SELECT e AS account_id, k AS b, min(g) AS bg FROM (SELECT *, max(k) OVER (PARTITION BY e) AS mk FROM p) WHERE k = mk GROUP BY 1, 2)"""
_W = """w AS (SELECT i.dst AS account_id, min(epoch_us(o.ts) - epoch_us(i.ts)) / 1e6 AS dwell_seconds FROM t i JOIN t o ON o.src = i.dst AND o.ts >= i.ts GROUP BY 1)"""
_V = """v AS (SELECT a.account_id, coalesce(f, 0) + coalesce(b, 0) AS max_multi_hop_velocity_hops,
  list_min(list_filter([fg, bg, CASE WHEN dwell_seconds <= 7200 THEN dwell_seconds END], lambda x: x IS NOT NULL)) AS min_hop_interval_seconds
  FROM a LEFT JOIN f USING (account_id) LEFT JOIN b USING (account_id) LEFT JOIN w USING (account_id))"""
_M = "m AS (SELECT * FROM cc JOIN sd USING (account_id) JOIN v USING (account_id))"
_ALL = f"WITH RECURSIVE {_T}, {_D}, {_A}, {_SHARED}, {_CC}, {_P}, {_FB}, {_W}, {_V}, {_M}"
_SIGNS = """s AS (SELECT *, shared_device_account_count >= 2 AS dev, local_clustering_coefficient >= 0.5 AS clu, max_multi_hop_velocity_hops >= 2 AS hop, coalesce(min_hop_interval_seconds <= 3600, false) AS spd FROM m)"""


def _ledger(spark, sf_dir):
    return ledgers.event_ledger(spark, sf_dir)


@query(f"WITH {_T} SELECT src, dst, value AS amount, epoch_us(ts) AS executed_us FROM t")
def ledger_transfers(spark, sf_dir):
    return _ledger(spark, sf_dir).transfers.select("src", "dst", "amount", micros(F.col("executed_at")).alias("executed_us"))


@query(f"WITH {_D} SELECT * FROM d")
def ledger_account_devices(spark, sf_dir):
    return _ledger(spark, sf_dir).account_devices


@query("""WITH r AS (SELECT event_id, user_id AS src, user_id + floor(value)::BIGINT % 3 AS dst, value - 50 AS amount, CASE WHEN user_id % 7 = 0 THEN '  ' ELSE event_type END AS channel FROM events)
SELECT event_id, 'self_transfer' AS reason FROM r WHERE src = dst UNION ALL SELECT event_id, 'amount_not_positive' FROM r WHERE amount <= 0
UNION ALL SELECT event_id, 'blank_channel' FROM r WHERE trim(channel) = ''""")
def invalid_transfers(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    rows = e.select(
        "event_id", F.col("user_id").alias("src"), (F.col("user_id") + F.floor("value").cast("long") % 3).alias("dst"), (F.col("value") - 50).alias("amount"),
        F.col("ts").cast("timestamp").alias("executed_at"), F.when(F.col("user_id") % 7 == 0, "  ").otherwise(F.col("event_type")).alias("channel"),
    )
    return validation.split(rows, validation.transfer_reasons())[1].select("event_id", F.explode("reasons").alias("reason"))


@query(f"""WITH {_T}, o AS (SELECT DISTINCT user_id AS account_id FROM events WHERE user_id % 10 <> 3 UNION SELECT -1),
e AS (SELECT src AS account_id FROM t UNION SELECT dst FROM t)
SELECT 'unknown_account' AS "check", CAST(account_id AS VARCHAR) AS subject FROM e ANTI JOIN o USING (account_id)
UNION ALL SELECT 'isolated_account', CAST(account_id AS VARCHAR) FROM o ANTI JOIN e USING (account_id)""")
def ledger_invariant_violations(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    some = led.accounts.where("account_id % 10 <> 3").union(spark.range(-1, 0).toDF("account_id"))
    return validation.violations(some, led.transfers)


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def isolated_accounts(spark, sf_dir):
    """Customers without an urgent order."""
    return validation.isolated(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "o_custkey")


_COUNTS = f"WITH {_D}, {_A}, {_SHARED} SELECT account_id, shared_device_account_count FROM sd"


@query(_COUNTS)
def shared_device_counts(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return signals.shared_devices(led.accounts, led.account_devices)


@query(_COUNTS)
def shared_device_overlap(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return evaluation.device_overlap(led.account_devices, led.accounts)


_CLUSTERING = f"WITH {_T}, {_A}, {_CC} SELECT account_id, round(local_clustering_coefficient, 9) AS local_clustering_coefficient FROM cc"


@query(_CLUSTERING)
def clustering_coefficients(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return _rounded(signals.clustering(led.accounts, led.transfers), "local_clustering_coefficient")


@query(_CLUSTERING)
def clustering_pair_probe(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return _rounded(evaluation.clustering_by_probe(led.transfers, led.accounts), "local_clustering_coefficient")


@query(f"WITH RECURSIVE {_T}, {_P} SELECT k, count(*) AS n FROM p GROUP BY k")
def velocity_paths_by_depth(spark, sf_dir):
    return signals.paths(_ledger(spark, sf_dir).transfers).groupBy("k").agg(F.count("*").alias("n"))


def _best_chains(spark, sf_dir, *, backward, **options):
    found = chains.best_chains(_ledger(spark, sf_dir).transfers, window_minutes=signals.WINDOW_MINUTES, max_hops=signals.MAX_HOPS, **options)
    return found.where(F.col("backward") == backward).select("account_id", "hops", F.round("gap", 6).alias("gap"))


@query(f"WITH RECURSIVE {_T}, {_P}, {_FB} SELECT account_id, f AS hops, round(fg, 6) AS gap FROM f")
def velocity_forward(spark, sf_dir):
    return _best_chains(spark, sf_dir, backward=False, most_listed=0)  # by the program over transfers


@query(f"WITH RECURSIVE {_T}, {_P}, {_FB} SELECT account_id, b AS hops, round(bg, 6) AS gap FROM b")
def velocity_backward(spark, sf_dir):
    return _best_chains(spark, sf_dir, backward=True)


@query(f"WITH RECURSIVE {_T}, {_A}, {_P}, {_FB}, {_W}, {_V} SELECT account_id, max_multi_hop_velocity_hops, round(min_hop_interval_seconds, 6) AS min_hop_interval_seconds FROM v")
def velocity_span(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    found = signals.velocity(led.accounts, led.transfers)
    return found.select("account_id", "max_multi_hop_velocity_hops", F.round("min_hop_interval_seconds", 6).alias("min_hop_interval_seconds"))


@query(f"WITH {_T}, {_W} SELECT * FROM w")
def pivot_dwell(spark, sf_dir):
    return signals.pivot_dwell(_ledger(spark, sf_dir).transfers)


_VERDICTS = f"""{_ALL}, {_SIGNS} SELECT account_id, round(local_clustering_coefficient, 9) AS local_clustering_coefficient, shared_device_account_count, max_multi_hop_velocity_hops,
round(min_hop_interval_seconds, 6) AS min_hop_interval_seconds, CASE WHEN dev AND (clu OR hop OR spd) THEN 'FLAGGED' ELSE 'SAFE' END AS verdict FROM s"""


def _verdict_rows(decided: DataFrame) -> DataFrame:
    return decided.select(
        "account_id", F.round("local_clustering_coefficient", 9).alias("local_clustering_coefficient"), "shared_device_account_count", "max_multi_hop_velocity_hops",
        F.round("min_hop_interval_seconds", 6).alias("min_hop_interval_seconds"), "verdict",
    )


@query(_VERDICTS)
def account_verdicts(spark, sf_dir):
    return _verdict_rows(verdicts.verdicts(_ledger(spark, sf_dir)))


@query(f"""{_ALL}, {_SIGNS}, g AS (SELECT * FROM s WHERE dev AND (clu OR hop OR spd))
SELECT account_id, 'device' AS code FROM g WHERE dev UNION ALL SELECT account_id, 'clustering' FROM g WHERE clu UNION ALL SELECT account_id, 'hops' FROM g WHERE hop UNION ALL SELECT account_id, 'speed' FROM g WHERE spd""")
def verdict_reason_codes(spark, sf_dir):
    return verdicts.verdicts(_ledger(spark, sf_dir)).select("account_id", F.explode("reason_codes").alias("code"))


@query(f"{_ALL}, {_SIGNS} SELECT account_id, CASE WHEN dev OR (hop AND spd) THEN 'FLAGGED' ELSE 'SAFE' END AS verdict FROM s")
def verdicts_alternative_rule(spark, sf_dir):
    return verdicts.verdicts(_ledger(spark, sf_dir), rule=verdicts.device_or_fast_chain).select("account_id", "verdict")


@query(f"""{_ALL}, th AS (SELECT * FROM (VALUES ('default', 0.5, 2, 2, 3600.0), ('lenient', 0.05, 1, 1, 7200.0), ('strict', 0.9, 5, 6, 60.0)) AS x(setting, c, d, h, i))
SELECT setting, CASE WHEN shared_device_account_count >= d AND (local_clustering_coefficient >= c OR max_multi_hop_velocity_hops >= h OR coalesce(min_hop_interval_seconds <= i, false)) THEN 'FLAGGED' ELSE 'SAFE' END AS verdict,
count(*) AS n FROM m, th GROUP BY 1, 2""")
def threshold_sweep(spark, sf_dir):
    many = {"default": verdicts.Thresholds(), "lenient": verdicts.Thresholds(0.05, 1, 1, 7200.0), "strict": verdicts.Thresholds(0.9, 5, 6, 60.0)}
    return verdicts.sweep(signals.signals(_ledger(spark, sf_dir)), many)


@query(f"""{_ALL}, th AS (SELECT p_partkey AS setting, (p_size % 5) * 0.1::DOUBLE AS c, p_partkey % 4 AS d, 1 + p_partkey % 6 AS h, 600.0 * (1 + p_size % 7) AS i FROM part)
SELECT setting, CASE WHEN shared_device_account_count >= d AND (local_clustering_coefficient >= c OR max_multi_hop_velocity_hops >= h OR coalesce(min_hop_interval_seconds <= i, false)) THEN 'FLAGGED' ELSE 'SAFE' END AS verdict,
count(*) AS n FROM m, th GROUP BY 1, 2""")
def threshold_sweep_of_table(spark, sf_dir):
    """A setting for each part, all from one count of the accounts by the thresholds that they meet."""
    part = _table(spark, sf_dir, "part")
    settings = part.select(
        F.col("p_partkey").alias("setting"), ((F.col("p_size") % 5) * F.lit(0.1)).alias("min_clustering_coefficient"), (F.col("p_partkey") % 4).alias("min_shared_device_neighbors"),
        (1 + F.col("p_partkey") % 6).alias("min_velocity_hops"), (600.0 * (1 + F.col("p_size") % 7)).alias("max_hop_interval_seconds"),
    )
    return verdicts.sweep_table(materialise(signals.signals(_ledger(spark, sf_dir))), settings)


@query(f"SELECT * FROM ({_VERDICTS}) WHERE account_id = (SELECT min(user_id) FROM events)")
def single_account_verdict(spark, sf_dir):
    """From a ledger laid out by account: chains, neighbours and devices of the one account, bucket by bucket."""
    led = _ledger(spark, sf_dir)
    return _verdict_rows(lookup.verdict_at(lookup.lookup(led, buckets=16), led.accounts.agg(F.min("account_id")).first()[0]))


_NEAREST = """SELECT query_id, row_id, score, rank FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))), 6) + 0.0 AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, r.vec_id) AS rank
  FROM q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) r) WHERE rank <= 3"""


_EVERY_20TH = f"WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0) {_NEAREST}"


def _every_20th(spark, sf_dir, **options):
    e = _table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.nearest(queries, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), 3, digits=6, **options)


@query(_EVERY_20TH)
def nearest_vectors_top3(spark, sf_dir):
    return _every_20th(spark, sf_dir)


@query(_EVERY_20TH)
def nearest_vectors_in_blocks(spark, sf_dir):
    """By cells, the way for rows that are too many to be sent."""
    return _every_20th(spark, sf_dir, most_sent=0, large_block=500)


@query(f"""{_ALL}, {_SIGNS}, q AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v FROM s JOIN embeddings e ON e.vec_id = s.account_id WHERE dev AND (clu OR hop OR spd)) {_NEAREST}""")
def nearest_vectors_flagged_only(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    flagged = verdicts.verdicts(_ledger(spark, sf_dir)).where("verdict = 'FLAGGED'").select("account_id")
    queries = materialise(e.join(flagged, F.col("vec_id") == F.col("account_id"), "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))
    return retrieval.nearest(queries, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), 3, digits=6)


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn, count(*) FILTER (toxic = 1 AND quality <> 0) AS fn FROM labels),
r AS (SELECT *, tp + fp + tn + fn AS total, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM c)
SELECT tp, fp, tn, fn, total, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END, 9) AS f1,
round(CASE WHEN total > 0 THEN (tp + tn) / total ELSE 1.0 END, 9) AS accuracy FROM r""")
def label_confusion(spark, sf_dir):
    return _rounded(evaluation.confusion(_table(spark, sf_dir, "labels"), "toxic = 1", "quality = 0"), "precision", "recall", "f1", "accuracy")


@query(f"""WITH {_T}, {_D}, {_A}, {_SHARED}, {_CC} SELECT account_id, 'shared_device_account_count' AS metric, CAST(shared_device_account_count + 1 AS DOUBLE) AS reported, CAST(shared_device_account_count AS DOUBLE) AS recomputed FROM sd WHERE account_id % 5 = 0
UNION ALL SELECT account_id, 'local_clustering_coefficient', round(local_clustering_coefficient + 0.25, 9), round(local_clustering_coefficient, 9) FROM cc WHERE account_id % 7 = 0""")
def metric_discrepancies(spark, sf_dir):
    """Independent recounts against signals that were changed for some accounts; for all others they agree."""
    led = _ledger(spark, sf_dir)
    measured = signals.clustering(led.accounts, led.transfers).join(signals.shared_devices(led.accounts, led.account_devices), "account_id")
    changed = measured.withColumn("shared_device_account_count", F.col("shared_device_account_count") + (F.col("account_id") % 5 == 0).cast("long"))
    changed = changed.withColumn("local_clustering_coefficient", F.col("local_clustering_coefficient") + F.when(F.col("account_id") % 7 == 0, 0.25).otherwise(0.0))
    return _rounded(evaluation.discrepancies(changed, led), "reported", "recomputed")


_CITED = """c AS (SELECT doc_id, doc_id % 60 AS citation_id, CASE WHEN doc_id % 7 = 0 THEN concat(b.text, '!') ELSE coalesce(b.text, '') END AS text FROM documents LEFT JOIN benchmark b ON b.item_id = doc_id % 60),
g AS (SELECT c.doc_id, c.citation_id, CASE WHEN b.item_id IS NULL THEN 'citation_id_not_in_corpus' WHEN c.text IS NOT DISTINCT FROM b.text THEN 'verified' ELSE 'text_mismatch' END AS status FROM c LEFT JOIN benchmark b ON b.item_id = c.citation_id)"""


def _cited(spark, sf_dir):
    bench = _table(spark, sf_dir, "benchmark")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 60).alias("citation_id"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.coalesce("text", F.lit("")))
    cited = docs.join(bench, F.col("item_id") == F.col("citation_id"), "left").select("doc_id", "citation_id", text.alias("text"))
    corpus = bench.select(F.col("item_id").alias("citation_id"), "text", F.col("item_id").alias("ordinal"))
    return evaluation.grounding_details(cited, corpus), corpus


@query(f"WITH {_CITED} SELECT * FROM g")
def grounding_details(spark, sf_dir):
    return _cited(spark, sf_dir)[0].select("doc_id", "citation_id", "status")


@query(f"""WITH {_CITED}, n AS (SELECT count(*) AS total_citations, count(*) FILTER (status = 'verified') AS verified_citations, count(*) FILTER (status <> 'verified') AS hallucinated_citations,
count(DISTINCT CASE WHEN status = 'verified' THEN citation_id END) AS distinct_verified FROM g), z AS (SELECT count(DISTINCT item_id) AS corpus_citations FROM benchmark)
SELECT *, CASE WHEN total_citations > 0 THEN verified_citations / total_citations ELSE 1.0 END AS "precision", distinct_verified / corpus_citations AS coverage, hallucinated_citations = 0 AS is_fully_grounded FROM n, z""")
def grounding_report(spark, sf_dir):
    return evaluation.grounding_report(*_cited(spark, sf_dir))


@query("SELECT doc_id, sha256(concat(source, '. ', text, ' Keywords: ', lang, ', ', source)) AS text_sha256 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def corpus_documents_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    return docs.select("doc_id", F.sha2(corpora.embedding_text(F.col("source"), F.col("text"), F.array("lang", "source")), 256).alias("text_sha256"))


_CHAIN = """r AS (SELECT conv_id, turn, concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, text) AS x, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations),
c AS (SELECT conv_id, turn, n, 'GENESIS' AS prev, sha256(concat('GENESIS|', x)) AS h FROM r WHERE n = 1 UNION ALL SELECT r.conv_id, r.turn, r.n, c.h, sha256(concat(c.h, '|', r.x)) FROM c JOIN r ON r.n = c.n + 1)"""


def _chained(spark, sf_dir):
    payload = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("payload"))
    return audit_chain.linked(rows, order=["conv_id", "turn"], payload_column="payload")


@query(f"WITH RECURSIVE {_CHAIN} SELECT conv_id, turn, n AS sequence_number, prev AS previous_entry_hash, h AS entry_hash FROM c")
def audit_chain_hashes(spark, sf_dir):
    return _chained(spark, sf_dir).drop("payload")


@query(f"WITH RECURSIVE {_CHAIN} SELECT max(n) AS sequence_number, arg_max(h, n) AS entry_hash FROM c")
def audit_head(spark, sf_dir):
    return _chained(spark, sf_dir).agg(F.max("sequence_number").alias("sequence_number"), F.max_by("entry_hash", "sequence_number").alias("entry_hash"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)
SELECT n AS sequence_number, 'link' AS kind FROM r WHERE n % 70 = 0 UNION ALL SELECT n, 'hash' FROM r WHERE n % 50 = 0 AND n % 70 <> 0""")
def audit_chain_verify(spark, sf_dir):
    """Every 50th entry's content is changed, every 70th entry's link; both are found, and nothing else."""
    n = F.col("sequence_number")
    chained = materialise(_chained(spark, sf_dir))
    changed = chained.withColumn("payload", F.when(n % 50 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    changed = changed.withColumn("previous_entry_hash", F.when(n % 70 == 0, F.lit("0")).otherwise(F.col("previous_entry_hash")))
    return audit_chain.broken_links(changed, F.sha2(F.concat("previous_entry_hash", F.lit("|"), F.col("payload")), 256))


#: Expected signals of the seeded ring: account, shared devices, hops, interval, verdict.
RING = [
    *[(f"ACC-PLACE-{i:03d}", 0, h, g, "SAFE") for i, (h, g) in enumerate([(1, None), (2, 6840.0), (2, 3780.0), (2, 3300.0)])],
    *[(f"ACC-LAYER-{i:03d}", 2, 2, g, "FLAGGED") for i, g in enumerate([3780.0, 3300.0, None])],
    *[(f"ACC-INTEG-{i:03d}", 0, 2, g, "SAFE") for i, g in enumerate([3300.0, 4260.0])],
    *[(f"ACC-LEGIT-{i:03d}", 0, 2, None, "SAFE") for i in range(10)],
]
HUB = [
    ("ACC-ADV-PLACE-000", 0, 3, 900.0, "SAFE"), ("ACC-ADV-HUB-000", 0, 3, 900.0, "SAFE"), ("ACC-ADV-LAYER-000", 0, 3, 900.0, "SAFE"), ("ACC-ADV-INTEG-000", 0, 3, 900.0, "SAFE"),
    *[(f"ACC-ADV-CUST-{i:03d}", 0, 1, None, "SAFE") for i in range(40)],
]


def _values(rows):
    return ", ".join("('{}', {}, {}, CAST({} AS DOUBLE), '{}')".format(a, b, c, "NULL" if d is None else d, e) for a, b, c, d, e in rows)


_GOLDEN = "SELECT account_id, 0.0::DOUBLE AS local_clustering_coefficient, d AS shared_device_account_count, h AS max_multi_hop_velocity_hops, i AS min_hop_interval_seconds, v AS verdict FROM (VALUES {}) AS x(account_id, d, h, i, v)"


@query(_GOLDEN.format(_values(RING)))
def ring_ledger_golden(spark, sf_dir):
    return _verdict_rows(verdicts.verdicts(ledgers.ring_ledger(spark)))


@query(_GOLDEN.format(_values(HUB)))
def hub_attack_golden(spark, sf_dir):
    return _verdict_rows(verdicts.verdicts(ledgers.hub_ledger(spark)))


@query("SELECT 3 AS tp, 0 AS fp, 16 AS tn, 0 AS fn, 19 AS total, 1.0::DOUBLE AS \"precision\", 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS accuracy, 0.0::DOUBLE AS max_clustering_error, 0.0::DOUBLE AS max_device_error, true AS has_zero_degradation")
def ring_topology_report(spark, sf_dir):
    ring = ledgers.ring_ledger(spark)
    return evaluation.topology_report(materialise(verdicts.verdicts(ring)), ring)[0]


@query("SELECT t AS account_type, v AS verdict, n FROM (VALUES ('PLACEMENT', 'SAFE', 4), ('LAYERING', 'FLAGGED', 3), ('INTEGRATION', 'SAFE', 2), ('LEGITIMATE', 'SAFE', 10)) AS x(t, v, n)")
def ring_verdicts_by_type(spark, sf_dir):
    ring = ledgers.ring_ledger(spark)
    return verdicts.verdicts(ring).join(ring.accounts, "account_id").groupBy("account_type", "verdict").agg(F.count("*").alias("n"))


@query("SELECT 'ACC-PLACE-' || lpad(CAST(i AS VARCHAR), 3, '0') AS account_id, 2 AS n_reached FROM range(4) AS x(i)")
def ring_two_hop_reach(spark, sf_dir):
    """How many integration accounts each placement account reaches through one account."""
    ring = ledgers.ring_ledger(spark)
    kind = lambda k: ring.accounts.where(F.col("account_type") == k).select("account_id")
    first = ring.transfers.join(kind("PLACEMENT"), F.col("src") == F.col("account_id"), "left_semi").select("src", F.col("dst").alias("mid"))
    second = ring.transfers.join(kind("INTEGRATION"), F.col("dst") == F.col("account_id"), "left_semi").select(F.col("src").alias("mid"), "dst")
    return first.join(second, "mid").groupBy(F.col("src").alias("account_id")).agg(F.count_distinct("dst").alias("n_reached"))


