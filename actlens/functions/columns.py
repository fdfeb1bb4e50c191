"""Scalar column functions (FN1-FN14) and the user-function surface (UDF1-3).

All of them are built-in Catalyst expressions (whole-stage codegen), no
Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# FN1 ---------------------------------------------------------------------
def location_name(run, layer, module) -> Column:
    """``{run}/{layer}_{module}``."""
    return F.format_string("%s/%s_%s", _c(run), _c(layer), _c(module))


def metadata_path(run) -> Column:
    return F.concat(_c(run), F.lit("/metadata.json"))


# FN2 ---------------------------------------------------------------------
def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def has_suffix(path, suffix: str) -> Column:
    return F.endswith(_c(path), F.lit(suffix))


def stem(path) -> Column:
    """Part of the base name before the first dot."""
    return F.substring_index(basename(path), ".", 1)


def url_bucket(url) -> Column:
    """3rd part of ``scheme://bucket/key`` split on '/'."""
    return F.element_at(F.split(_c(url), "/"), 3)


def url_key(url) -> Column:
    """4th and later parts joined by '/'."""
    parts = F.split(_c(url), "/")
    return F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/")


def replace_suffix(path, old: str, new: str) -> Column:
    p = _c(path)
    cut = F.substring(p, F.lit(1), F.length(p) - F.lit(len(old)))
    return F.when(F.endswith(p, F.lit(old)), F.concat(cut, F.lit(new))).otherwise(p)


# FN3 ---------------------------------------------------------------------
def parse_answer(text, n) -> Column:
    """Correct if ``ANSWER: n`` is in the upper-cased reply."""
    return F.contains(F.upper(_c(text)), F.concat(F.lit("ANSWER: "), _c(n).cast("string")))


# FN4 ---------------------------------------------------------------------
def map_choice(pred, f1, f2) -> Column:
    """Chosen feature -> 1 / 2, otherwise null."""
    p = _c(pred)
    return F.when(p == _c(f1), F.lit(1)).when(p == _c(f2), F.lit(2))


def choice_from_correct(correct, correct_index, f1, f2) -> Column:
    """correct -> correct_index, else the other one of (f1, f2)."""
    ci = _c(correct_index)
    return F.when(_c(correct), ci).otherwise(F.when(ci == _c(f1), _c(f2)).otherwise(_c(f1)))


# FN5 ---------------------------------------------------------------------
def utc_string(epoch_seconds) -> Column:
    """Epoch seconds -> ``yyyy-MM-dd HH:mm:ss`` (session time zone is UTC)."""
    return F.date_format(F.timestamp_seconds(_c(epoch_seconds)), "yyyy-MM-dd HH:mm:ss")


# FN6 / FN7 / FN8 / FN9 / FN10 -------------------------------------------
def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: an expression inside a
    lambda is computed again for every element."""
    return F.transform(F.array(value), use)[0]


def softmax(vec) -> Column:
    def shares(e: Column) -> Column:
        return _bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s))

    def scaled(v: Column) -> Column:
        return _bound(F.array_max(v), lambda m: _bound(F.transform(v, lambda x: F.exp(x - m)), shares))

    return _bound(_c(vec), scaled)


def argmax(vec) -> Column:
    """0-based index of the first maximum."""
    v = _c(vec)
    return (F.array_position(v, F.array_max(v)) - F.lit(1)).cast("int")


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def jump_relu(x, log_threshold) -> Column:
    r = relu(x)
    return F.when(r > F.exp(_c(log_threshold)), r).otherwise(F.lit(0.0))


def jump_step(x, log_threshold) -> Column:
    return (relu(x) > F.exp(_c(log_threshold))).cast("int")


def sparse_topk(vec, k: int) -> Column:
    """Top-k entries of a row as array<struct<value, index>>, value desc, index asc."""
    v = _c(vec)
    pairs = F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("index")))
    top = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(top, lambda s: F.struct((-s["neg"]).alias("value"), s["index"].alias("index")))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, z: acc + z)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, eps: float = 1e-8) -> Column:
    """Cosine with norms clamped at eps (as the tensor library does)."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


# FN11 / UDF1 --------------------------------------------------------------
BOS = 50256  # fixed value: begin/end-of-text id of the GPT-2 vocabulary


def template(token, spec: str, *, bos: int = BOS, space: int = 220, excl: int = 0,
             pad: int = 0) -> Column:
    """Context list around a token for a named strategy."""
    t = _c(token).cast("bigint")
    specs: dict[str, list] = {
        "t": [t],
        "bos_t": [F.lit(bos), t],
        "bos_t_excl": [F.lit(bos), t, F.lit(excl)],
        "t_t": [t, t],
        "sp_t": [F.lit(space), t],
        "sp_sp_t": [F.lit(space), F.lit(space), t],
        "pad_bos_t": [F.lit(pad), F.lit(bos), t],
    }
    if spec not in specs:
        raise ValueError(f"unknown strategy {spec!r}")
    return F.array(*[x.cast("bigint") for x in specs[spec]])


def strategies_column(token, strategies: dict[str, Callable[[Column], Column]]) -> Column:
    """UDF1: map strategy name -> context list, built from user Column functions."""
    items = []
    for name, fn in strategies.items():
        items += [F.lit(name), fn(_c(token))]
    return F.create_map(*items)


# FN12 / FN13 --------------------------------------------------------------
def decode_sample(tokens, n: int = 64) -> Column:
    """First n whitespace tokens back to text."""
    return F.array_join(F.slice(_c(tokens), 1, n), " ")


def token_count(tokens) -> Column:
    return F.size(_c(tokens))


# FN14 ---------------------------------------------------------------------
def hist_struct(counts, edges) -> Column:
    return F.struct(_c(counts).alias("counts"), _c(edges).alias("edges"))
