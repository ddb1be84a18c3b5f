"""Problem 6: per-page text statistics and the type of the main body: prose, list, table or junk.

Method: thresholds on the statistics are noisy labelling functions. Their accuracies are learned from their agreements by
expectation-maximization (no labels); the pages enter as counts of vote patterns, so all pages take part and the driver
sees a table bounded by the number of patterns. The posterior of the types decides.

Defined results: null ids go, a repeated page_id counts once; pages without main body have null statistics ratios, the type
`empty` and are no cases; cases of problem 7 are no cases.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import p7_residue
from corpusloom.session import cut

TYPES = ("prose", "list", "table", "junk")
ROUNDS = 50

# Frequent function words of English, French and Malay.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these may first then do any my now such like our over me even most made after also did many off before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year come since against go came right used take three where without until once although ask every "
    "le la les de des du un une et est dans pour que qui sur avec par au aux ne pas ce cette il elle nous vous leur sans avant plus se son sa ses ou où été sont "
    "yang dan di ke dari untuk dengan ini itu tidak pada adalah oleh akan telah sebelum tanpa atau juga dalam bagi kepada setiap jika selepas".split()
)
_CODE = "{};=<>\\|~^$#@*_"
_ASCII = re.compile(r"[\x00-\x7f]+")
_DIGIT = re.compile(r"\d")
_ENDED = re.compile(r"[.?!]\W{0,4}(?:\(\d+\))?\s*$")
_CELL = re.compile(r"\t|\s{2,}|[|;,]")
_VOWEL = re.compile(r"[aeiouyàâéèêëîïôöûüáíóúä]", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^\s*(?:[\-*•·»>]|\d{1,3}[.)])\s")
STATS = ("lines", "words", "word_length", "symbols", "digits", "ended", "common", "bullets", "in_prose", "vowelless", "long_words", "cells", "repeats", "in_long")


@functools.lru_cache(1 << 16)
def _piece(piece: str) -> tuple[tuple[str, ...], int, int, int, int]:
    """The words of a piece between white space: themselves, their number, letters, function words, words without vowels."""
    own = tuple(_WORDS.findall(piece.lower()))
    return own, len(own), sum(map(len, own)), sum(w in FUNCTION_WORDS for w in own), sum(_VOWEL.search(w) is None for w in own)


def statistics(body: list[tuple[str, str, str]]) -> tuple[float | None, ...]:
    """STATS over the main-body lines (line, plain text, kind): counts, then ratios."""
    text = "\n".join(t for _, t, _ in body)
    rare = "" if text.isascii() else _ASCII.sub("", text)
    chars = tokens = long = words = letters = known = silent = 0
    different: set[str] = set()
    for piece, n in Counter(text.split()).items():  # pieces recur, within a page and over pages
        own, k, l, f, v = _piece(piece)
        tokens += n
        chars += n * len(piece)
        long += n * (len(piece) > 24)
        words += n * k
        letters += n * l
        known += n * f
        silent += n * v
        different.update(own)
    if not tokens:
        return (float(len(body)), 0.0) + (None,) * (len(STATS) - 2)
    in_prose = in_long = ended = 0
    for x, t, k in body:
        n = t.count(" ") + 1
        stop = x.rstrip()[-1:] in (".", "?", "!", "…") or _ENDED.search(x[-14:]) is not None
        ended += n * stop
        in_long += n * (n >= 12)
        in_prose += n * (k == "p" and stop)
    cells = sum(len(x) < 160 and len(_CELL.findall(x)) >= 2 and len(_WORDS.findall(x)) <= 8 for x, _, _ in body)
    return (
        float(len(body)),
        float(tokens),
        letters / max(1, words),
        sum(map(text.count, _CODE)) / chars,
        (sum(map(text.count, "0123456789")) + len(_DIGIT.findall(rare))) / chars,
        ended / tokens,
        known / max(1, words),
        sum(bool(_BULLET.match(x)) for x, _, _ in body) / len(body),
        in_prose / tokens,
        silent / max(1, words),
        long / tokens,
        cells / len(body),
        1 - len(different) / max(1, words),
        in_long / tokens,
    )


def votes(s: tuple[float | None, ...]) -> str:
    """One letter of each labelling function: p, l, t, j for the types, - where it abstains."""
    if not s[1]:
        return "-" * 11
    lines, words, length, symbols, digits, ended, common, bullets, in_prose, vowelless, long_words, cells, _, in_long = s
    return "".join(
        (
            "p" if in_prose >= 0.35 else ("-" if in_prose >= 0.08 else "n"),
            "p" if ended >= 0.5 else ("-" if ended >= 0.25 else "n"),
            "p" if common >= 0.2 else ("-" if common >= 0.13 else "n"),
            "j" if symbols >= 0.06 else ("-" if symbols >= 0.02 else "o"),
            "t" if digits >= 0.25 else ("-" if digits >= 0.1 else "o"),
            "j" if vowelless >= 0.3 or long_words >= 0.2 else ("-" if vowelless >= 0.15 else "o"),
            "t" if cells >= 0.6 else ("-" if cells >= 0.3 else "o"),
            "l" if bullets >= 0.6 else ("-" if bullets >= 0.3 else "o"),
            "l" if lines >= 5 and words / lines <= 9 and in_prose < 0.15 else ("-" if words / max(1, lines) <= 12 else "o"),
            "p" if in_long >= 0.5 and common >= 0.2 else ("-" if in_long >= 0.5 else "o"),
            "j" if (length >= 9 or length <= 2.6) else "o",
        )
    )


#: what each function's letters mean at the start of the learning: the types they speak for
_MEANS = {"p": (0,), "n": (1, 2, 3), "l": (1,), "t": (2,), "j": (3,), "o": ()}


def fit(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
    """(type shares, for each function the probability of each letter given each type), learned by EM over vote patterns."""
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    k, m = len(TYPES), len(patterns[0]) if patterns else 0
    letters = [sorted({p[j] for p in patterns}) for j in range(m)]
    share = np.array([0.85, 0.05, 0.05, 0.05])
    prob: list[dict[str, np.ndarray]] = []
    for j in range(m):
        d = {}
        for x in letters[j]:
            means = _MEANS.get(x, ())
            d[x] = np.array([0.3 if x == "-" else (0.7 if c in means else (0.5 if x == "o" else 0.1)) for c in range(k)])
        total = sum(d.values())
        prob.append({x: v / total for x, v in d.items()})
    for _ in range(rounds):
        post = posterior(patterns, share, prob) * weight[:, None]
        share = (post.sum(axis=0) + 1) / (post.sum() + k)
        for j in range(m):
            new = {}
            for x in letters[j]:
                at = np.array([p[j] == x for p in patterns])
                prior = 2.0 * prob[j][x]  # the meanings stay attached to the types
                new[x] = post[at].sum(axis=0) + prior
            total = sum(new.values())
            prob[j] = {x: v / total for x, v in new.items()}
    return share, prob


def posterior(patterns: list[str], share: np.ndarray, prob: list[dict[str, np.ndarray]]) -> np.ndarray:
    out = np.tile(np.log(share), (len(patterns), 1))
    floor = np.full(len(share), 0.05)
    for i, p in enumerate(patterns):
        for j, x in enumerate(p):
            if x != "-":
                out[i] += np.log(np.maximum(prob[j].get(x, floor), 1e-4))
    out = np.exp(out - out.max(axis=1, keepdims=True)) if len(patterns) else out
    return out / out.sum(axis=1, keepdims=True) if len(patterns) else out


_SCHEMA = ", ".join(f"{c} double" for c in STATS)


def types(pages: DataFrame) -> DataFrame:
    """(page_id, STATS, type, p_prose, residue): the statistics and the type of every page."""
    spark = pages.sparkSession
    bodies, models = p7_residue.prepare(pages)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, gone = [], []
            for m in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                body = p7_residue.split_body(*m)
                rows.append(statistics(body))
                gone.append(p7_residue.residue([(x, t) for x, t, _ in body], models.value)[0])
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([votes(r) for r in rows], pa.string()), pa.array(gone, pa.bool_())], ["page_id", *STATS, "votes", "residue"])

    stats = cut(bodies.mapInArrow(describe, f"page_id bigint, {_SCHEMA}, votes string, residue boolean"))
    # at most 4 ** 11 patterns, whatever the number of pages
    counts = {r.votes: r.n for r in stats.filter("words > 0 and not residue").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    share, prob = fit(counts)
    patterns = sorted({r.votes for r in stats.select("votes").distinct().toLocalIterator()})
    post = posterior(patterns, share, prob)
    rows = [(p, TYPES[int(q.argmax())], float(q[0])) for p, q in zip(patterns, post)] or [("", TYPES[0], 1.0)]
    table = spark.createDataFrame(rows, "votes string, type string, p_prose double")
    out = stats.join(F.broadcast(table), "votes", "left")
    return out.select("page_id", *STATS, F.when(F.col("words") > 0, F.col("type")).otherwise("empty").alias("type"), F.when(F.col("words") > 0, F.col("p_prose")).alias("p_prose"), "residue")


def found(pages: DataFrame) -> DataFrame:
    return types(pages).filter("words > 0 and not residue and p_prose < 0.5").select("page_id")
