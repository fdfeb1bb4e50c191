"""Language identification by families first, then pairs of languages.

A text is reduced to lower-case letters and single spaces and described by its
hashed byte trigrams (square roots of counts, unit length). Linear support
vector machines, one per family against the rest, choose the language family;
within the family, one machine per pair of languages votes with its margin.

A family of more than ``MOST_IN_FAMILY`` languages (of unknown codes, say) is
cut into several by the order of the codes, so machines grow with the number of
languages, not with its square.

The machines are fitted on a bounded sample of different labelled rows: of each
language the first ``PER_LANGUAGE`` by a hash of id and text (of ``SALTS`` parts of
them twice an equal share each, before they meet), or an equal share of
``FIT_ROWS`` where there are many languages, but every language is learned.
They are collected as trigram counts. Prediction is one pass over whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0; if
nothing can be learned, every text is ``und``; rows with a null id or language
are predicted but never learned from; repeated rows are predicted alike and
learned once; an empty table gives an empty result; other columns pass through
untouched, but columns of the names of the prediction are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.common import materialize, released, small_or_none

DIMS = 1 << 13
PER_LANGUAGE = 400
FIT_ROWS = 12_000
MOST_IN_FAMILY = 16
SALTS = 64
MAX_BROADCAST_ROWS = 500_000
UNDETERMINED = "und"

#: fixed values: language families by ISO 639-1 code
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(), "baltic": "lt lv".split(), "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he mt am".split(), "indic": "hi bn ur pa gu mr ne si".split(),
    "iranian": "fa ps ku tg".split(), "dravidian": "ta te kn ml".split(), "celtic": "ga cy gd br".split(),
    "sinitic": ["zh"], "japonic": ["ja"], "koreanic": ["ko"], "hellenic": ["el"],
    "austronesian": "id ms tl jv".split(), "austroasiatic": "vi km".split(), "tai": "th lo".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], "other")


def families_of(langs: list[str]) -> dict[str, str]:
    """Family by language; large families are cut into equal parts."""
    members: dict[str, list[str]] = {}
    for lang in sorted(langs):
        members.setdefault(family_of(lang), []).append(lang)
    out = {}
    for family, names in members.items():
        parts = -(-len(names) // MOST_IN_FAMILY)
        for i, lang in enumerate(names):
            out[lang] = family if parts == 1 else f"{family}-{i * parts // len(names):04d}"
    return out


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed byte trigrams, or None without a letter."""
    if not text:
        return None
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(c.isalpha() for c in letters):
        return None
    b = np.frombuffer(f" {letters} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=DIMS)


def unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.sqrt(x @ x)


def linear_svm(x: np.ndarray, rows: np.ndarray, positive: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss over some
    rows of x, by dual coordinate ascent; the classes weigh the same in total."""
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(y)
    slack = 1.0 / (2 * cost * share)
    norms = 2.0 + slack                  # unit rows and a constant 1 for the bias
    w, bias, alpha = np.zeros(x.shape[1], x.dtype), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            v = x[rows[i]]
            step = max(-alpha[i], (1 - y[i] * (float(w @ v) + bias) - slack[i] * alpha[i]) / norms[i])
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * v
                bias += step * y[i]
    return np.append(w, np.float32(bias))


@dataclass
class LanguageModel:
    families: list[str]
    languages: dict[str, list[str]]     # by family, sorted
    weights: np.ndarray                 # one row per machine, bias last
    pairs: dict[str, list[tuple[int, int, int]]]  # family -> (language a, language b, machine)
    sharpness: float = 4.0

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        margins = self.weights[:, :-1] @ unit(counts) + self.weights[:, -1]
        score, best = 1.0, 0
        if len(self.families) > 1:
            e = margins[:len(self.families)] * self.sharpness
            p = np.exp(e - e.max())
            best = int(p.argmax())
            score = float(p[best] / p.sum())
        family = self.families[best]
        names = self.languages[family]
        if len(names) > 1:
            votes = np.zeros(len(names))
            for a, b, k in self.pairs[family]:
                p = 1 / (1 + np.exp(-self.sharpness * margins[k]))
                votes[a] += p
                votes[b] += 1 - p
            best = int(votes.argmax())
            return names[best], score * float(votes[best]) / (len(names) - 1)
        return names[0], score


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel | None:
    """x: unit trigram vectors, one per learned text."""
    if not langs:
        return None
    lang = np.array(langs)
    named = families_of(sorted(set(langs)))
    family = np.array([named[v] for v in langs])
    families = sorted(set(family))
    every = np.arange(len(langs))
    machines, pairs, languages = [], {}, {}
    for f in families:
        machines.append(linear_svm(x, every, family == f) if len(families) > 1 else np.zeros(DIMS + 1, np.float32))
    for f in families:
        names = languages[f] = sorted(set(lang[family == f]))
        pairs[f] = []
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                some = np.flatnonzero((lang == names[a]) | (lang == names[b]))
                pairs[f].append((a, b, len(machines)))
                machines.append(linear_svm(x, some, lang[some] == names[a]))
    return LanguageModel(families, languages, np.stack(machines), pairs)


def _sampled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(lang, c) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
               if (c := trigram_counts(text)) is not None]
        used = [np.flatnonzero(c) for _, c in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, _ in out], pa.string()),
             pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()),
             pa.array([c[u].astype(np.uint32).tobytes() for (_, c), u in zip(out, used)], pa.binary())],
            names=["lang", "at", "n"])


def fit_languages(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE,
                  fit_rows: int = FIT_ROWS) -> LanguageModel | None:
    """Fits on a bounded sample of the rows that ``learn_from`` selects."""
    key = F.xxhash64("doc_id", "text")
    usable = (docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & F.col("doc_id").isNotNull())
              .select(F.col("lang").cast("string").alias("lang"), "text", key.alias("key")))
    keys = usable.groupBy("lang", "key").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)))

    def first(rows: DataFrame, n: int, *groups: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("key"))).filter(F.col("rank") <= n)
    # a frequent language is cut down in SALTS parts before its rows meet
    few = first(keys, 2 * -(-per_language // SALTS), "lang", "salt").drop("rank")
    chosen = materialize(first(few, per_language, "lang").drop("n", "salt"), "language-sample")
    n_langs = chosen.select("lang").distinct().count()
    if not n_langs:
        return None
    chosen = chosen.filter(F.col("rank") <= max(1, min(per_language, fit_rows // n_langs)))
    picked = usable.join(small_or_none(chosen.select("lang", "key"), MAX_BROADCAST_ROWS), ["lang", "key"]) \
        .dropDuplicates(["lang", "key"]).select("lang", "text")
    # sorted, so that the machines do not depend on how Spark dealt the rows
    rows = sorted(tuple(r) for r in picked
                  .mapInArrow(released(_sampled_counts), "lang string, at binary, n binary").collect())
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (_, at, n) in enumerate(rows):
        x[i, np.frombuffer(at, np.uint16)] = np.sqrt(np.frombuffer(n, np.uint32))
        x[i] /= np.linalg.norm(x[i])
    return fit(x, [r[0] for r in rows])


def predict_languages(docs: DataFrame, model: LanguageModel | None, lang_column: str = "lang_pred",
                      score_column: str = "lang_score", keep: tuple[str, float] | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score.

    With ``keep=(rejected language, least score)`` the rejected rows go and no
    column is added."""
    docs = docs if keep else docs.drop(lang_column, score_column)
    at = docs.columns.index("text")
    added = [] if keep else [T.StructField(lang_column, T.StringType()), T.StructField(score_column, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at).to_pylist():
                c = trigram_counts(text) if model else None
                lang, score = (UNDETERMINED, 0.0) if c is None else model.predict(c)
                langs.append(lang)
                scores.append(score)
            if keep:
                yield batch.filter(pa.array([a != keep[0] and s >= keep[1] for a, s in zip(langs, scores)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*batch.schema.names, lang_column, score_column])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, *added]))
