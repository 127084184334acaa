"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fetch, map_text, materialize, trim_memory, utf8, worker_cache

LETTER = re.compile(rb"[A-Za-z]")
SCHEMA = "lang_pred string, score double"
#: Longest n-gram; the share of its words (of its n-grams) that a unit must make up in a language to be known there. Shares add up
#: to one, so a language knows at most 1 / share units, at any size of the corpus and however small the language is.
LONGEST, LEAST_WORD, LEAST_GRAM = 5, 1e-5, 1e-5


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def clear_workers() -> None:
    """Counting begins with empty caches: what another operator, or an earlier model, left in this worker is given back first."""
    worker_cache("langid").clear()
    trim_memory()


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang", flush: int = 200_000) -> DataFrame:
    """(lang, word, n) over whole texts: A-Z lower-cased words counted per task, then summed by one shuffle.

    Rows with a null text or language are left out. A task holds at most about ``flush`` distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_workers()
        seen: dict[str, Counter] = {}
        unbroken = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for name, words in seen.items():
                keys = list(words)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = body.lower().split()
                seen.setdefault(name, Counter()).update(found)
                unbroken += len(body) if len(body) > 64 * len(found) else 0
            if sum(map(len, seen.values())) > flush or unbroken > 1 << 25:  # few words may be long ones
                yield from emit()
                unbroken = 0
        yield from emit()
        trim_memory()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """log10 frequencies: a row of ``words`` or ``grams`` has one value for each language.

    Every language's row is smoothed by ``add``, so a unit that one language lacks still counts against it.
    """

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], longest: int):
        self.langs, self.longest, self.name = langs, longest, uuid.uuid4().hex
        width = max(len(langs), 1)
        self.words = {w.encode(): k for k, w in enumerate(words)}
        self.grams = {g: k for k, g in enumerate(grams)}
        self.word_rows = np.array([*words.values()], np.float64).reshape(-1, width)
        self.gram_rows = np.array([*grams.values()], np.float64).reshape(-1, width)

    def units(self, word: str) -> list[int]:
        """The n-grams that stand for an unknown word: at each place the longest known one that starts there, else shorter ones."""
        marked, found, get = f"<{word}>", [], self.grams.get
        for at in range(len(marked)):
            for end in range(min(at + self.longest, len(marked)), at, -1):
                if (k := get(marked[at:end])) is not None:
                    found.append(k)
                    break
        return found

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of unknown words: the mean of their units, so a long word weighs no more than a known one; zeros without any."""
        parts = [self.units(w) for w in words]
        n = np.array([len(p) for p in parts])
        flat = np.fromiter((k for p in parts for k in p), np.int64, int(n.sum()))
        total = np.zeros((len(words), max(len(self.langs), 1)))
        np.add.at(total, np.repeat(np.arange(len(words)), n), self.gram_rows[flat])
        return total / np.maximum(n, 1)[:, None]

    def start(self):
        """A function from texts to predictions; words met are kept in a cache of bounded size that a worker's tasks share."""
        held = worker_cache("langid")
        if held.get("name") != self.name:
            held.clear()
            held.update(name=self.name, index=dict(self.words), rows=self.word_rows, size=0)
        width = len(self.langs)

        def numbers(words: list[bytes]) -> list[int]:
            index = held["index"]
            new = [w for w in set(words) if w not in index]
            if new:
                held["size"] += sum(map(len, new))
                if len(index) + len(new) > len(self.words) + 400_000 or held["size"] > 1 << 25:
                    held.update(index=(index := dict(self.words)), rows=self.word_rows)
                    new = [w for w in set(words) if w not in index]
                    held["size"] = sum(map(len, new))
                index.update(zip(new, range(len(held["rows"]), len(held["rows"]) + len(new))))
                held["rows"] = np.concatenate([held["rows"], self.unseen([w.decode("utf-8", "ignore") for w in new])])
            return [*map(index.__getitem__, words)]

        def work(texts: list[bytes | None]) -> dict[str, list]:
            # words of several texts are looked up together, in parts of bounded size
            totals, lengths = np.zeros((len(texts), max(width, 1))), np.zeros(len(texts), np.int64)
            words: list[bytes] = []
            owner: list[tuple[int, int]] = []

            def flush() -> None:
                if words:
                    rows = held["rows"][ids] if (ids := numbers(words)) else None
                    np.add.at(totals, [k for k, _ in owner], np.add.reduceat(rows, np.cumsum([0] + [n for _, n in owner[:-1]]), axis=0))
                words.clear()
                owner.clear()

            known = [bool(width) and has_letter(t) for t in texts]
            for k, text in enumerate(texts):
                found = text.lower().split() if known[k] else []
                lengths[k] = len(found)
                for i in range(0, len(found), 1 << 17):
                    part = found[i : i + (1 << 17)]
                    words += part
                    owner.append((k, len(part)))
                    if len(words) > 1 << 17:
                        flush()
            flush()
            # natural logs, tempered by the root of the length: words of a text aren't independent
            odds = totals / np.sqrt(np.maximum(lengths, 1))[:, None] * math.log(10)
            odds = np.exp(odds - odds.max(axis=1, keepdims=True, initial=-np.inf)) if len(texts) else odds
            best = odds.argmax(axis=1) if len(texts) else []
            return {
                "lang_pred": [self.langs[b] if ok else "und" for b, ok in zip(best, known)],
                "score": [float(o.max() / o.sum()) if ok else 0.0 for o, ok in zip(odds, known)],
            }

        return work


def gram_counts(words: DataFrame, longest: int, flush: int = 300_000) -> DataFrame:
    """(lang, unit, n): all character n-grams up to ``longest`` of whole marked words, weighted by the words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_workers()
        seen: dict[str, dict[str, int]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for name, units in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(units), pa.string()), pa.array([*units], pa.string()), pa.array([*units.values()], pa.int64())], names=["lang", "unit", "n"])
            seen.clear()

        for batch in batches:
            for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                marked, units = f"<{word}>", seen.setdefault(name, {})
                get, size = units.get, len(marked)
                for at in range(size):
                    for end in range(at + 1, min(at + longest, size) + 1):
                        unit = marked[at:end]
                        units[unit] = get(unit, 0) + n
                    if at % 65_536 == 65_535 and len(units) > flush:  # a word may be a whole text without spaces
                        yield from emit()
                        units = seen.setdefault(name, {})
                        get = units.get
            if sum(map(len, seen.values())) > flush:
                yield from emit()
        yield from emit()
        trim_memory()

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least_word: float = LEAST_WORD, least_gram: float = LEAST_GRAM, add: float = 0.5) -> Model:
    """Count words and n-grams by language over all of ``docs`` and keep as a model what is known to a language.

    A word is known if it makes up ``least_word`` of a language's words in one language at least, an n-gram likewise with ``least_gram`` of its
    n-grams; a unit that is known anywhere has its counts in all languages. So the model that is broadcast has at most 1 / share units for each
    language, a frequent language doesn't crowd out a rare one, and the rule is the same at every size. Other words are scored by their n-grams.
    Counts cover every row with a text and a language, and whole words of any length. Without such rows the model knows
    no language and predicts ``und``. Rows are one number per language: tags are expected to be language codes, not free text.
    """
    counts = materialize(word_counts(docs, text, lang))
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {}, longest)
    grams = materialize(gram_counts(counts, longest))
    gram_sizes = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    def best(units: DataFrame, totals: dict[str, int], least: float) -> dict[str, np.ndarray]:
        need = F.create_map(*[F.lit(x) for name in langs for x in (name, float(max(totals.get(name, 0), 1)) * least)])
        known = units.withColumn("known", F.col("n") >= F.element_at(need, F.col("lang")))
        wide = known.groupBy("unit").agg(*[F.sum(F.when(F.col("lang") == name, F.col("n"))).alias(f"n{k}") for k, name in enumerate(langs)], F.max("known").alias("known"))
        kept = fetch(wide.filter("known")).sort_values("unit")
        # a unit that is not kept isn't missing: frequencies are over all of a language's units
        table = kept[[f"n{k}" for k in range(len(langs))]].fillna(0).to_numpy(float) + add
        return dict(zip(kept["unit"], np.log10(table / (np.array([totals.get(name, 0) for name in langs], float) + add * max(len(kept), 1)))))

    model = Model(langs, best(counts.withColumnRenamed("word", "unit"), sizes, least_word), best(grams, gram_sizes, least_gram), longest)
    discard(counts, grams)
    return model


def predict(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (the language's share of the evidence, 0 to 1) to every row.

    A text that is null, empty or without a letter gets ``und`` and 0. Ties go to the first language by code point.
    Repeated rows are scored alike; input columns named like the two new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, lambda: shared.value.start(), SCHEMA, carry, text)
