"""The canonical tables of the data model, derived from the input tables.

Each derived table has a Spark definition and the same definition as SQL
text (the DuckDB oracle composes its checks from these snippets), so both
sides start from identical inputs:

* activations - ``embeddings`` as 10-position sequences in 100-row batches
* dictionary  - feature j has enc_j = dec_j = embedding of vec_id j
* experts     - expert e = label e, router row = mean embedding of the label,
                features = the first 4 vec_ids of the label
* latents     - top-4 encode of every activation with the 32-feature dictionary
* run_log     - ``events`` as per-user training logs
* tokens      - whitespace tokens of ``documents`` with vocabulary ranks
* ratings     - two raters from ``labels``
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens import session
from actlens.operators import ordering, scoring, text
from actlens.sources.tables import read_table

# Fixed values of the fixture model (must match on both sides).
N_FEATURES = 32
TOPK = 4
N_EXPERT_FEATURES = 4
SEQ_LEN = 10
BATCH_ROWS = 100
BOS_TOKEN = 50256
WHITESPACE = r"\s+"


# --------------------------------------------------------------------------
# activations
# --------------------------------------------------------------------------

def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label",
        F.expr("vec_id div 10").alias("sample_id"),
        (F.col("vec_id") % SEQ_LEN).cast("int").alias("pos"),
        F.expr("vec_id div 100").alias("batch_id"),
        F.col("embedding").alias("vec"))


ACT_SQL = ("SELECT vec_id, label, vec_id // 10 AS sample_id, CAST(vec_id % 10 AS INTEGER) AS pos, "
           "vec_id // 100 AS batch_id, embedding AS vec FROM embeddings")

# long form: one row per (vec_id, dim) with DOUBLE values, dims 0-based
ACT_LONG_SQL = ("SELECT a.vec_id, a.label, a.sample_id, a.pos, a.batch_id, "
                "CAST(u.i - 1 AS INTEGER) AS dim, CAST(a.vec[u.i] AS DOUBLE) AS x "
                f"FROM ({ACT_SQL}) a, LATERAL (SELECT unnest(range(1, len(a.vec) + 1)) AS i) u")


def activations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activations(spark, sf_dir)
    return a.select("vec_id", "label", "sample_id", "pos", "batch_id",
                    F.posexplode("vec").alias("dim", "x")) \
            .withColumn("x", F.col("x").cast("double"))


def image_path(vec_id) -> F.Column:
    return F.concat(F.lit("img/"), (vec_id % 10).cast("string"), F.lit("/"),
                    vec_id.cast("string"), F.lit(".jpg"))


PATH_SQL = "('img/' || CAST(vec_id % 10 AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.jpg')"


# --------------------------------------------------------------------------
# dictionaries
# --------------------------------------------------------------------------

def _rows_to_matrix(rows, key: str, vec: str) -> np.ndarray:
    rows = sorted(rows, key=lambda r: r[key])
    return np.array([np.asarray(r[vec], dtype=np.float64) for r in rows])


def model_weights(vectors) -> np.ndarray:
    """Weights that a fixture encoder carries: a parameter, at most 512 MB."""
    w = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    if w.nbytes > scoring.MAX_BROADCAST_BYTES:
        raise ValueError(f"the encoder's weights take more than {scoring.MAX_BROADCAST_BYTES} bytes")
    return w


def at_layer(x: np.ndarray, layer: int) -> np.ndarray:
    """Fixture layers: each stretches positive components by a quarter."""
    return np.where(x > 0, x * 1.25 ** layer, x)


def mean_vector(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Per-dimension mean of all embeddings (d_in values: a parameter)."""
    e = read_table(spark, sf_dir, "embeddings")
    rows = e.select(F.posexplode("embedding").alias("dim", "x")) \
            .groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    return np.array([r["m"] for r in sorted(rows, key=lambda r: r["dim"])])


def dictionary(spark: SparkSession, sf_dir: str, n_features: int = N_FEATURES,
               pre_b: str = "zero", with_bias: bool = False,
               with_threshold: bool = False) -> scoring.Dictionary:
    """Fixture dictionary: enc_j = dec_j = embedding of vec_id j (j < n_features)."""
    e = read_table(spark, sf_dir, "embeddings")
    rows = e.where(F.col("vec_id") < n_features).select("vec_id", "embedding").collect()
    if len(rows) != n_features:
        raise ValueError(f"need {n_features} dictionary rows, found {len(rows)}")
    w = _rows_to_matrix(rows, "vec_id", "embedding")
    d_in = w.shape[1]
    pb = mean_vector(spark, sf_dir) if pre_b == "mean" else np.zeros(d_in)
    d = scoring.Dictionary(enc=w, dec=w.copy(), pre_b=pb)
    if with_bias:
        d.b_enc = np.array([bias_of(j) for j in range(n_features)])
    if with_threshold:
        d.log_threshold = np.array([log_threshold_of(j) for j in range(n_features)])
    return d


def log_threshold_of(j: int) -> float:
    return math.log(0.05 + 0.01 * (j % 5))


def bias_of(j: int) -> float:
    """Encoder bias of the vanilla fixture: -0.01 * (j % 3)."""
    return -0.01 * (j % 3)


def dict_sql(n_features: int = N_FEATURES) -> str:
    return (f"SELECT CAST(vec_id AS INTEGER) AS feature, embedding::DOUBLE[] AS w "
            f"FROM embeddings WHERE vec_id < {n_features}")


MEAN_SQL = ("SELECT list(m ORDER BY dim) AS mu FROM (SELECT u.i AS dim, avg(CAST(e.embedding[u.i] AS DOUBLE)) AS m "
            "FROM embeddings e, LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u GROUP BY u.i)")


def expert_tables(spark: SparkSession, sf_dir: str):
    """(Dictionary with experts, n_experts) from the label groups."""
    e = read_table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    feats = e.select("label", "vec_id", "embedding", F.row_number().over(w).alias("rn")) \
             .where(F.col("rn") <= N_EXPERT_FEATURES).collect()
    labels = sorted({r["label"] for r in feats})
    if labels != list(range(len(labels))):
        raise ValueError("expert labels must be 0..n-1")
    n_exp = len(labels)
    feats = sorted(feats, key=lambda r: (r["label"], r["rn"]))
    enc = np.array([np.asarray(r["embedding"], dtype=np.float64) for r in feats])
    means = e.select("label", F.posexplode("embedding").alias("dim", "x")) \
             .groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    d_in = enc.shape[1]
    router = np.zeros((n_exp, d_in))
    for r in means:
        router[r["label"], r["dim"]] = r["m"]
    d = scoring.Dictionary(enc=enc, dec=enc.copy(), pre_b=np.zeros(d_in), router=router,
                           router_b=np.zeros(d_in), n_experts=n_exp)
    return d, n_exp


EXPERT_FEATURES_SQL = (
    "SELECT label AS expert, CAST(label * 4 + rn - 1 AS INTEGER) AS feature, w FROM ("
    "SELECT label, vec_id, embedding::DOUBLE[] AS w, "
    "row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 4")

ROUTER_SQL = (
    "SELECT label AS expert, list(m ORDER BY dim) AS r FROM ("
    "SELECT e.label, u.i AS dim, avg(CAST(e.embedding[u.i] AS DOUBLE)) AS m FROM embeddings e, "
    "LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u GROUP BY e.label, u.i) GROUP BY label")

# --------------------------------------------------------------------------
# latents
# --------------------------------------------------------------------------

LATENT_KEYS = ("vec_id", "sample_id", "pos", "batch_id")


def latents(spark: SparkSession, sf_dir: str, k: int = TOPK) -> DataFrame:
    """The stored latents table: encoded once (Arrow scoring), written under the
    checkpoint folder, then read by every consumer (top-k, activity, pairs...)."""
    from actlens.session import materialize
    d = dictionary(spark, sf_dir)
    return materialize(scoring.encode(activations(spark, sf_dir), d, "topk", k=k, key_cols=LATENT_KEYS), "latents")


def latents_sql(k: int = TOPK) -> str:
    return (
        "SELECT vec_id, sample_id, pos, batch_id, 0 AS expert, feature, value FROM ("
        "SELECT a.vec_id, a.sample_id, a.pos, a.batch_id, d.feature, "
        "list_dot_product(a.vec::DOUBLE[], d.w) AS value, "
        "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.vec::DOUBLE[], d.w) DESC, d.feature) AS rk "
        f"FROM ({ACT_SQL}) a, ({dict_sql()}) d) WHERE rk <= {k}")


# --------------------------------------------------------------------------
# run logs
# --------------------------------------------------------------------------

def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    x = ev.select(
        F.col("user_id").alias("run"), "ts", "event_id",
        F.col("event_type").alias("event"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"))
    # step = row number per run by time; a busy run is split by day
    day = F.floor(F.col("timestamp") / F.lit(86_400)).cast("bigint")
    return ordering.running_index(x, ["ts"], group_cols=["run"], bucket=day, name="step", base=1)


RUN_LOG_SQL = (
    "SELECT user_id AS run, ts, event_id, event_type AS event, value, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) / 1e6 AS timestamp, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events")


# --------------------------------------------------------------------------
# tokens
# --------------------------------------------------------------------------

def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, token): non-empty parts of text split on whitespace."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = F.array_remove(F.split("text", WHITESPACE), "")
    # the _outer form keeps Spark from inferring a size(split(text)) > 0 filter and
    # pushing it below the input spreading (the split would run twice, once unspread)
    return d.select("doc_id", F.posexplode_outer(parts).alias("pos", "token")).where(F.col("token").isNotNull())


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, token_id): token_id = 0-based rank in the sorted vocabulary."""
    from actlens.session import materialize
    d = read_table(spark, sf_dir, "documents").select(F.array_distinct(F.split("text", WHITESPACE)).alias("words"))
    # a word leaves each document once; counted and numbered below
    toks = materialize(d.select(F.explode_outer("words").alias("token")).where(F.col("token") != "").distinct())
    return materialize(ordering.running_index(toks, ["token"], name="token_id"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, token, token_id)."""
    return doc_tokens(spark, sf_dir).join(vocabulary(spark, sf_dir), on="token", how="inner")


DOC_TOKENS_SQL = ("SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS pos, t.parts[u.i] AS token FROM ("
                  "SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS parts "
                  "FROM documents) t, LATERAL (SELECT unnest(range(1, len(t.parts) + 1)) AS i) u")

VOCAB_SQL = (f"SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS token_id "
             f"FROM (SELECT DISTINCT token FROM ({DOC_TOKENS_SQL}))")

TOKEN_IDS_SQL = (f"SELECT t.doc_id, t.pos, t.token, v.token_id FROM ({DOC_TOKENS_SQL}) t "
                 f"JOIN ({VOCAB_SQL}) v USING (token)")


# --------------------------------------------------------------------------
# ratings
# --------------------------------------------------------------------------

def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters over pairs (doc_id, doc_id+1); truth = doc_id % 2 + 1."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").alias("idx1"), (F.col("doc_id") + 1).alias("idx2"),
        F.col("quality").alias("r1"), (F.lit(1) - F.col("toxic")).alias("r2"),
        (F.col("doc_id") % 2).cast("int").alias("truth"))


RATINGS_SQL = ("SELECT doc_id AS idx1, doc_id + 1 AS idx2, quality AS r1, 1 - toxic AS r2, "
               "CAST(doc_id % 2 AS INTEGER) AS truth FROM labels")


# --------------------------------------------------------------------------
# token vectors and per-position similarity
# --------------------------------------------------------------------------

def n_embeddings(spark: SparkSession, sf_dir: str) -> int:
    return read_table(spark, sf_dir, "embeddings").count()


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, layer, vec): token -> embedding of vec_id = token_id % n_embeddings."""
    n = n_embeddings(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("layer"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    v = vocabulary(spark, sf_dir).select("token_id", (F.col("token_id") % n).alias("vec_id"))
    return v.join(e, on="vec_id", how="inner").drop("vec_id")


def _texts(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(doc_id, tokens, at): a text's tokens as embedding numbers. Rows that share a
    doc_id are one text, its tokens ordered by position (``at``)."""
    words = text.whitespace_tokens(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    vid = lambda t: t % F.lit(n)
    ids = text.encode_words(docs, vocabulary(spark, sf_dir)).where(F.col("tokens").isNotNull()) \
        .select("doc_id", F.transform("tokens", vid).alias("tokens"))
    repeated = read_table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > 1).select("doc_id")
    no_places = F.lit(None).cast("array<int>").alias("at")
    if not repeated.limit(1).count():
        return ids.select("doc_id", "tokens", no_places)
    ids, repeated = session.materialize(ids, "text-ids"), session.materialize(repeated, "repeated-ids")
    same = ids["doc_id"].eqNullSafe(repeated["doc_id"])
    merged = ids.join(repeated, same, "left_semi").select("doc_id", F.posexplode("tokens").alias("p", "t")) \
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", "t"))).alias("s"))
    return ids.join(repeated, same, "left_anti").select("doc_id", "tokens", no_places).unionByName(
        merged.select("doc_id", F.col("s")["t"].alias("tokens"), F.col("s")["p"].alias("at")))


def _cosine_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    # token vector = embedding[token_id % n]
    n = n_embeddings(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings")
    e0 = e.where(F.col("vec_id") == 0).select("embedding").first()
    vectors = e.select(F.col("vec_id").alias("vid"), F.col("label").alias("layer"), F.col("embedding").alias("vec"))
    return _texts(spark, sf_dir, n), vectors, np.asarray(e0["embedding"], dtype=np.float64)


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, layer, strategy, cos) for every token that has a successor.

    Context vector at a position = own + next token vector; it is compared
    with three unigram vectors: own, next and the constant vec of id 0.
    """
    c = text.successor_cosines(*_cosine_inputs(spark, sf_dir))
    return c.unpivot(["doc_id", "pos", "layer"], ["own", "next", "const"], "strategy", "cos")


def similarity_series(spark: SparkSession, sf_dir: str, part_tokens: int, most: int) -> list[DataFrame]:
    """``similarity`` with one row per text and layer: (doc_id, layer, pos, own, next,
    const), arrays in token order; in parts of whole texts, of about ``part_tokens``
    tokens but at most ``most``."""
    return text.successor_cosine_parts(*_cosine_inputs(spark, sf_dir), per_text=True, part_tokens=part_tokens, most=most)


TOKEN_VEC_SQL = (
    f"SELECT v.token_id, e.label AS layer, e.embedding::DOUBLE[] AS vec FROM ({VOCAB_SQL}) v "
    "JOIN embeddings e ON e.vec_id = v.token_id % (SELECT count(*) FROM embeddings)")


def _cos_sql(a: str, b: str) -> str:
    return (f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8) * "
            f"greatest(sqrt(list_dot_product({b}, {b})), 1e-8))")


SIMILARITY_SQL = f"""
SELECT doc_id, pos, layer, strategy, cos FROM (
 SELECT doc_id, pos, layer,
        {_cos_sql('ctx', 'own')} AS c_own, {_cos_sql('ctx', 'nxt')} AS c_next, {_cos_sql('ctx', 'e0')} AS c_const
 FROM (
  SELECT t.doc_id, CAST(t.pos AS INTEGER) AS pos, o.layer, o.vec AS own, n.vec AS nxt,
         list_transform(range(1, len(o.vec) + 1), lambda i: o.vec[i] + n.vec[i]) AS ctx,
         (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS e0
  FROM ({TOKEN_IDS_SQL}) t
  JOIN ({TOKEN_IDS_SQL}) t2 ON t2.doc_id = t.doc_id AND t2.pos = t.pos + 1
  JOIN ({TOKEN_VEC_SQL}) o ON o.token_id = t.token_id
  JOIN ({TOKEN_VEC_SQL}) n ON n.token_id = t2.token_id))
UNPIVOT (cos FOR strategy IN (c_own AS 'own', c_next AS 'next', c_const AS 'const'))
"""

# run classes for the log-derived summaries (fixed labels)
RUN_CLASSES = ("relu", "topk", "topk_experts")


def run_class(run) -> F.Column:
    r = run % 3
    return F.when(r == 0, F.lit("relu")).when(r == 1, F.lit("topk")).otherwise(F.lit("topk_experts"))


RUN_CLASS_SQL = "CASE run % 3 WHEN 0 THEN 'relu' WHEN 1 THEN 'topk' ELSE 'topk_experts' END"


def n_experts_of(run) -> F.Column:
    """Expert count of a run's settings: null, 2, 4 or 8 by run % 4."""
    r = run % 4
    return F.when(r == 0, F.lit(None).cast("int")).when(r == 1, F.lit(2)).when(r == 2, F.lit(4)).otherwise(F.lit(8))


N_EXPERTS_SQL = "CASE run % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END"
