"""Reading level of each document's spoken text by a familiar-word formula.

A word is familiar if it stands in at least ``familiar`` of a language's documents; all others are unfamiliar. The formula
weighs the share of unfamiliar words (at several thresholds) and the average sentence length. Recognition and encoding errors
are words in under ``noise`` of the documents, as hard words may be: how many of a text's words are that rare is a share of its
own, so that the labels tell what it is worth. The weights, for each level and language, are fitted to labelled documents by
linear discriminants.

Document frequencies cover all documents. The lists that are broadcast hold words in at least ``noise`` of a language's
documents, for languages of at least ``least_language`` of the documents: at most (words of a document) / (``noise`` x
``least_language``) entries, whatever the corpus's size.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut
from tidewheel.llm.mojibake import Detector

NOISE = 0.01
FAMILIAR = (0.2, 0.35, 0.5)
#: Features beside those shares: of unlisted words, mean log frequency, sentence length.
EXTRA = 3
LEAST_LANGUAGE = 0.001
#: Labelled documents that the weights are fitted to, at most; the smallest by a hash of their id.
FIT_ROWS = 50_000
#: A sentence below this length is a call or an answer and says nothing about the style, unless there are no others.
SHORT = 4

_NUMBER = re.compile(r"\n[^\S\n]*\d+[^\S\n]*$")
_FRAMED = re.compile(r"^﻿?[^\S\n]*\{\d*\}\{\d*\}(.*)$", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>|\{\\[^{}\n]{0,40}\}|\{[A-Za-z]:[^{}\n]*\}")
_SOUND = re.compile(r"\[[^\[\]]{0,80}\]|\([^()]{0,80}\)|\*[^*\n]+\*|#[^#\n]+#|[♪♫][^♪♫]*[♪♫]?")
_SPEAKER = re.compile(r"^\s*(?:[-–—]\s*)?[^\W\d_][\w.'’]*(?: [^\W\d_][\w.'’]*){0,2}:\s+(?=\S)", re.M)
# What marks a cue as an advert or a credit, in lower case; and ends of host names.
ADVERT_MARKS = (
    "http", "h t t p", "www", "-=", "=-", "subtitle", "sous-titre", "untertitel", "subtitul", "subtítul", "legenda", "субтитр", "перевод", "traducc", "traduzi", "traduit par", "übersetz",
    "synced", "sync by", "encoded", "download", "advert", " subs ", "do not resell", "play cards", "support us", "sponsor", "скачать", "реклам", "werbung", "publicité", "publicidad", "descarg", "télécharg",
)
HOST_ENDS = ("example", "invalid", "test", "com", "net", "org", "info", "tv")
_HOST = re.compile(rf"\w@\w|\w ?\. ?(?:{'|'.join(HOST_ENDS)})\b")
_MARKS = ahocorasick.Automaton()
for _m in (*ADVERT_MARKS, "@", *(d + e for d in (".", ". ") for e in HOST_ENDS)):
    _MARKS.add_word(_m, _m)
_MARKS.make_automaton()
_GARBLED = re.compile(r"[\x80-\x9f�©®±¼½¾¤§¨ª¬¯´¶¸¹²³µºƒ†‡•‰‹›€™√∂∏∑∞∫≈≠≤≥─-▓Ђ-Џђ-џÃÂÐÑâ]|&[A-Za-z]{2,6};|\+[A-Za-z0-9+/]{2,40}-")
_SENTENCE = re.compile(r"[.!?…]+|\n\n+-")
_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_PLAIN = Detector({})


def _marked(lower: str) -> bool:
    return next(_MARKS.iter(lower), None) is not None


def _advert(cue: str) -> bool:
    lower = re.sub(r"\s+", " ", cue.lower())
    return any(m in ADVERT_MARKS for _, m in _MARKS.iter(lower)) or bool(_HOST.search(lower))


def speech(text: str) -> str:
    """What is spoken in a subtitle file: no numbers, times, markup, adverts, sounds or speakers; empty without cues."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _GARBLED.search(text):
        text = "\n".join(_PLAIN.repair(x)[1] if _GARBLED.search(x) else x for x in text.split("\n"))
    text = text.replace("\xa0", " ")
    if "->" in text:
        cues = []
        lines = text.split("\n")
        times = [i for i, x in enumerate(lines) if "->" in x and any(c.isdigit() for c in x)]
        for at, end in zip(times, [*times[1:], len(lines)]):
            cues.append(_NUMBER.sub("", "\n".join(["", *lines[at + 1 : end]]).rstrip()))
    elif "{" in text:
        cues = [c.replace("|", "\n") for c in _FRAMED.findall(text)]
    else:
        return ""
    if _marked(text.lower()):
        cues = [c for c in cues if not _advert(c)]
    said = "\n".join(cues)
    if "<" in said or "{" in said:
        said = _TAG.sub("", said)
    said = _SOUND.sub(" ", said)
    if ":" in said:
        said = _SPEAKER.sub("", said)
    return said


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any, in lower case."""
    return [w for w in (_WORD.findall(s) for s in _SENTENCE.split(speech(text).lower())) if w]


def spoken(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, label, words, lengths) of each document with spoken text; narrow. Null, empty, blank and cue-less texts give no row."""
    picked = documents.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.trim(F.col(language))).alias("label"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def work(batches):
        for b in batches:
            said = [sentences(t) for t in b.column(2).to_pylist()]
            rows = pa.array([i for i, s in enumerate(said) if s], pa.int64())
            kept = [s for s in said if s]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array([[w for s in d for w in s] for d in kept], pa.list_(pa.string())), pa.array([[len(s) for s in d] for d in kept], pa.list_(pa.int32()))],
                names=["doc_id", "label", "words", "lengths"],
            )

    return picked.mapInArrow(work, "doc_id long, label string, words array<string>, lengths array<int>")


def word_lists(said: DataFrame, noise: float = NOISE, least_language: float = LEAST_LANGUAGE) -> dict[str, dict[str, float]]:
    """Document frequency shares of each language's words, of those from ``noise`` on; over all documents.

    Labels and words are filtered where they are counted: what comes to the driver is what is kept.
    """
    sizes = said.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = said.count()
    big = F.broadcast(sizes.where(F.col("size") >= max(1.0, least_language * total)))  # at most 1 / least_language rows
    words = said.join(big, "label").select("label", "size", F.explode(F.array_distinct("words")).alias("word"))
    counted = words.groupBy("label", "size", "word").count().where((F.col("count") >= 2) & (F.col("count") >= noise * F.col("size")))
    lists: dict[str, dict[str, float]] = {}
    for r in counted.select("label", "word", (F.col("count") / F.col("size")).alias("share")).collect():
        lists.setdefault(r["label"], {})[r["word"]] = r["share"]
    return lists


_FEATURES = "doc_id long, language string, known double, " + ", ".join(f"f{i} double" for i in range(EXTRA + len(FAMILIAR)))


def features(said: DataFrame, shared, familiar: tuple[float, ...] = FAMILIAR) -> DataFrame:
    """Of each document its language by its words (the label may be wrong), shares of unfamiliar words, mean log frequency and sentence length.

    A word is looked up once a batch and language; what is done by document is done for all of a batch at a time.
    """

    def work(batches):
        names = sorted(shared.value)
        for b in batches:
            n = len(b)
            if not n:
                continue
            words, labels = b.column(2), b.column(1).to_pylist()
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            codes, texts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            of = np.repeat(np.arange(n), size)
            known: dict[str, np.ndarray] = {}

            def shares(name: str) -> np.ndarray:
                if name not in known:
                    own = shared.value[name]
                    known[name] = np.array([own.get(t, 0.0) for t in texts])
                return known[name]

            own = np.array([names.index(x) if x in shared.value else -1 for x in labels])
            best, hits, share = np.full(n, -1), np.zeros(n), np.zeros(len(codes))

            def take(docs: np.ndarray, number: int) -> None:
                """Lets a language have those of ``docs`` of whose words it knows more than the best one yet."""
                at = docs[of]
                s = shares(names[number])[codes[at]]
                got = np.bincount(of[at], weights=s > 0, minlength=n)
                better = docs & (got > hits)
                best[better], hits[better] = number, got[better]
                share[better[of]] = shares(names[number])[codes[better[of]]]

            for number in np.unique(own[own >= 0]):
                take(own == number, number)
            rest = (own < 0) | (hits < 0.6 * size)
            hits[rest], best[rest] = 0, -1
            if rest.any():
                for number in range(len(names)):
                    take(rest, number)
            share[(best < 0)[of]] = 0
            listed = share > 0
            count = np.maximum(1, hits)
            # outside the list of familiar words are the rarer listed ones and the unlisted; the share of these is told apart
            rows = [np.bincount(of, weights=share < f, minlength=n) / size for f in familiar]
            rows.append(1 - hits / size)
            rows.append(np.bincount(of, weights=np.log(np.where(listed, share, 1)), minlength=n) / count)
            lengths = b.column(3)
            number = pc.list_value_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64)
            each, to = lengths.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), number)
            long = np.bincount(to, weights=each >= SHORT, minlength=n)
            mean = np.where(long > 0, np.bincount(to, weights=each * (each >= SHORT), minlength=n) / np.maximum(1, long), np.bincount(to, weights=each, minlength=n) / np.maximum(1, number))
            rows.append(np.log(mean))
            language = pa.array([names[i] if i >= 0 else None for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), language, pa.array(hits / np.maximum(1, size)), *(pa.array(x) for x in rows)], names=[c.split()[0] for c in _FEATURES.split(", ")])

    return said.mapInArrow(work, _FEATURES)


def discriminants(x: np.ndarray, y: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Linear discriminants with a pooled covariance: (levels, weights, offsets)."""
    levels = sorted(set(y.tolist()))
    means = np.array([x[y == c].mean(0) for c in levels])
    rest = np.concatenate([x[y == c] - m for c, m in zip(levels, means)])
    pooled = rest.T @ rest / max(1, len(x) - len(levels)) + np.diag(1e-4 + 1e-3 * x.var(0))
    w = np.linalg.solve(pooled, means.T).T
    return levels, w, -0.5 * (w * means).sum(1)


def fit(labelled: list, least: int = 60) -> dict:
    """Weights by language (at least ``least`` labels), over all, and by sentence length alone. ``labelled``: rows of features and ``level``."""
    x = np.array([[r[f"f{i}"] for i in range(EXTRA + len(FAMILIAR))] for r in labelled])
    y = np.array([r["level"] for r in labelled])
    by: dict[str, list[int]] = {}
    for i, r in enumerate(labelled):
        by.setdefault(r["language"], []).append(i)
    model = {"language": {k: discriminants(x[i], y[i]) for k, i in by.items() if k is not None and len(i) >= least and len(set(y[i].tolist())) == len(set(y.tolist()))}}
    known = np.array([r["known"] >= 0.3 for r in labelled])
    model["all"] = discriminants(x[known], y[known]) if known.any() else None
    model["length"] = discriminants(x[:, -1:], y)
    return model


def levels(found: DataFrame, shared_model) -> DataFrame:
    """(doc_id, level) of each row of features."""

    def work(batches):
        model = shared_model.value
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 3 + EXTRA + len(FAMILIAR))]) if len(b) else np.zeros((0, EXTRA + len(FAMILIAR)))
            language, known = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            use = np.array([(k if k in model["language"] else "") if n >= 0.3 and (k in model["language"] or model["all"]) else None for k, n in zip(language, known)], object)
            out = np.zeros(len(b), np.int64)
            for k in set(use.tolist()):
                at = np.array([u == k for u in use], bool)
                names, w, offset = model["length"] if k is None else model["language"].get(k) or model["all"]
                out[at] = np.array(names)[np.argmax((x[at] if k is not None else x[at, -1:]) @ w.T + offset, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "level"])

    return found.mapInArrow(work, "doc_id long, level long")


def read_levels(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_labelled: bool = False) -> DataFrame:
    """(doc_id, level) of each document with spoken text that is not labelled (or, with ``keep_labelled``, of all).

    Without labels, or with labels of documents without speech only, there is nothing to go by: no rows. A document
    labelled twice counts once, with its smaller level; labels of no document are ignored.
    """
    spark = documents.sparkSession
    said = cut(spoken(documents))
    found = cut(features(said, spark.sparkContext.broadcast(word_lists(said))))
    given = labels.where(F.col("level").isNotNull()).groupBy("doc_id").agg(F.min("level").cast("long").alias("level"))
    sample = found.join(given, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    if not sample:
        return spark.createDataFrame([], "doc_id long, level long")
    model = spark.sparkContext.broadcast(fit(sample))
    return levels(found if keep_labelled else found.join(labels.select("doc_id"), "doc_id", "left_anti"), model)
