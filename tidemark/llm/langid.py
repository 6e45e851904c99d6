"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Texts become lower-case letters with single spaces.  Per language, the highest order keeps absolute
counts and lower orders count the different symbols that stand before a gram; each order takes a
discount and gives what it took to the next lower one.  All orders are sorted arrays of gram hashes
with one column per language.  The language with the lowest cross-entropy per symbol is chosen; a
text whose best cross-entropy is beyond what held-back labelled texts show is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, text_slices

ORDER = 4
SPACE = 32
PART_BYTES = 1 << 19
UNKNOWN = "und"
#: Bound of the labelled sample that the models are fitted on: documents per language, characters per document.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 20_000
CALIBRATE_ONE_IN = 4
#: Labelled rows from which a language spares some for its limit of rejection; one with fewer learns from all and rejects nothing.
CALIBRATE_LEAST = 8
LETTER = r"\p{L}"
#: Bits per symbol beyond the worst held-back text of a language from which a text is rejected.
REJECT_BITS = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)

_letters = np.full(0x110000, -1, np.int32)


def symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all rows, bounds of each row's scored symbols, letters per row).  A row is ORDER - 1
    spaces, which are context only, then its words, each with a space after it."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    new = np.unique(points[_letters[points] < 0])
    for p in new.tolist():
        c = chr(p)
        _letters[p] = ord(c.lower()[0]) if c.isalpha() else SPACE
    sym = _letters[points]
    n = len(at) - 1
    letter = sym != SPACE
    row = np.repeat(np.arange(n), np.diff(at))
    after = np.zeros(len(sym), bool)  # the first non-letter after a letter of the same row
    after[1:] = ~letter[1:] & letter[:-1] & (row[1:] == row[:-1])
    last = at[1:][np.diff(at) > 0] - 1
    tail = np.zeros(n, np.int64)  # a word that ends the row has no non-letter after it
    tail[row[last[letter[last]]]] = 1
    keep = np.flatnonzero(letter | after)
    sizes = np.bincount(row[keep], minlength=n) + tail
    ends = np.cumsum(sizes + ORDER - 1)
    first = ends - sizes
    out = np.full(int(ends[-1]) if n else 0, SPACE, np.int64)
    shift = first - (np.cumsum(np.bincount(row[keep], minlength=n)) - np.bincount(row[keep], minlength=n))
    out[np.arange(len(keep)) + shift[row[keep]]] = sym[keep]
    return out, np.stack([first, ends], axis=1), np.bincount(row[letter], minlength=n)


def gram_hash(chars: np.ndarray) -> np.ndarray:
    """Hash of grams given as columns of symbols, oldest first; depends on their number."""
    h = np.full(len(chars), chars.shape[1] * int(_STEP) & (1 << 64) - 1, np.uint64)
    for k in range(chars.shape[1]):
        h = mix((h ^ chars[:, k].astype(np.uint64)) * _STEP)
    return h


class Models:
    """Kneser-Ney models of all languages.  ``grams[n]`` and ``contexts[n]``: sorted hashes and a value
    per language; absent grams add 0, absent contexts pass everything on."""

    def __init__(self, languages: list[str], lang: np.ndarray, chars: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.alphabet = len(np.unique(chars[:, -1])) + 1 if len(chars) else 1
        self.grams, self.contexts, self.limit = {}, {}, np.full(len(languages), np.inf)
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # a lower order counts the different symbols before a gram
                key = gram_hash(chars)
                _, first = np.unique(np.stack([lang.astype(np.uint64), key]), axis=1, return_index=True)
                lang, chars, counts = lang[first], chars[first][:, 1:], np.ones(len(first))
            frame = pd.DataFrame({"l": lang, "g": gram_hash(chars), "c": gram_hash(chars[:, :-1]), "n": counts})
            gram = frame.groupby(["l", "g", "c"], sort=False, as_index=False)["n"].sum()
            ones, twos = (gram[gram.n == k].groupby("l").size().reindex(range(len(languages)), fill_value=0) for k in (1, 2))
            discount = np.clip((ones / np.maximum(ones + 2 * twos, 1)).to_numpy(float), 0.1, 0.9)
            context = gram.groupby(["l", "c"], as_index=False).agg(total=("n", "sum"), kinds=("n", "size"))
            gram = gram.merge(context, on=["l", "c"])
            gram["value"] = np.maximum(gram.n - discount[gram.l], 0) / gram.total
            context["value"] = np.minimum(discount[context.l], 1) * context.kinds / context.total
            self.grams[n] = self._table(gram, "g", 0.0)
            self.contexts[n] = self._table(context, "c", 1.0)

    def _table(self, frame: pd.DataFrame, key: str, absent: float) -> tuple[np.ndarray, np.ndarray]:
        hashes, at = np.unique(frame[key].to_numpy(np.uint64), return_inverse=True)
        values = np.full((len(hashes) + 1, len(self.languages)), absent, np.float32)
        values[at, frame.l.to_numpy(int)] = frame.value.to_numpy(np.float32)
        return hashes, values

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        hashes, values = table
        if not len(hashes):
            return values[np.zeros(len(keys), np.int64)]
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return values[np.where(hashes[at] == keys, at, len(hashes))]

    def bits(self, chars: np.ndarray) -> np.ndarray:
        """Bits of the last symbol of each gram after the others, per language."""
        p = np.full((len(chars), len(self.languages)), 1.0 / self.alphabet)
        for n in range(1, ORDER + 1):
            own = chars[:, ORDER - n :]
            p = self._look(self.grams[n], gram_hash(own)) + self._look(self.contexts[n], gram_hash(own[:, :-1])) * p
        return -np.log2(np.maximum(p, 1e-12))

    def entropies(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row and language bits per symbol (0 without letters); symbols; letters."""
        sym, bounds, letters = symbols(raw, offs)
        sizes = bounds[:, 1] - bounds[:, 0]
        spots = np.flatnonzero(np.repeat(np.tile([False, True], len(sizes)), np.stack([np.full(len(sizes), ORDER - 1), sizes], axis=1).ravel()))
        code = np.zeros(len(spots), np.uint64)
        for k in range(ORDER - 1, -1, -1):
            code = (code ^ sym[spots - k].astype(np.uint64)) * _STEP
            code ^= code >> np.uint64(29)
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        grams = np.stack([sym[spots[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1) if len(spots) else np.zeros((0, ORDER), np.int64)
        bits = self.bits(grams)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(sizes), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate([[0.0], np.cumsum(bits[:, k][which])])
            out[:, k] = np.diff(total[ends]) / np.maximum(sizes, 1)
        return out, sizes, letters


def _sample(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, sample_docs: int, sample_chars: int) -> DataFrame:
    """About ``sample_docs`` different labelled rows with letters per language (all, where it has no more), spread
    by a hash of id and text.  A longer text gives a piece of ``sample_chars`` characters from a place of its hash.
    ``fold`` 0 is held back: every fourth row of a language that has at least CALIBRATE_LEAST."""
    said = F.col(text).cast("string")
    key = lambda use: F.xxhash64(F.lit(use), F.col(doc_id), said)
    rows = docs.where(learn & F.col(lang).isNotNull() & said.rlike(LETTER)).select(F.col(lang).cast("string").alias("lang"), said.alias("text"), key("sample").alias("key"), key("piece").alias("piece"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key")).collect()}
    if not counts:
        return rows.select("lang", "text", F.lit(0).alias("fold")).limit(0)
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / n))])
    rows = rows.where(F.pmod("key", F.lit(1 << 30)) < rates[F.col("lang")] * F.lit(float(1 << 30)))
    piece = lambda start: F.substring("text", start, F.lit(sample_chars))
    some = piece((F.pmod("piece", F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1).cast("int"))
    rows = rows.withColumn("text", F.when(some.rlike(LETTER), some).otherwise(piece(F.regexp_instr("text", F.lit(LETTER))))).dropDuplicates(["lang", "key"])
    of = Window.partitionBy("lang")
    held = (F.count(F.lit(1)).over(of) >= CALIBRATE_LEAST) & (F.row_number().over(of.orderBy("key")) % CALIBRATE_ONE_IN == 0)
    return rows.select("lang", "text", F.when(held, 0).otherwise(1).alias("fold"))


def fit(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Models from a bounded sample of labelled rows: at most about ``sample_docs`` per language of at
    most ``sample_chars`` characters, pieces of longer texts.  Gram counts are summed by Spark; their
    number is bounded by the sample.  Every language with a labelled letter is learned.  Where one has
    enough rows, one in CALIBRATE_ONE_IN is held back to set its limit of rejection: the highest
    cross-entropy there, and REJECT_BITS."""
    sample = _sample(docs, learn, doc_id, text, lang, sample_docs, sample_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, j, raw, offs in text_slices(batch, "text", PART_BYTES):
                sym, bounds, _ = symbols(raw, offs)
                sizes = bounds[:, 1] - bounds[:, 0]
                spots = np.concatenate([np.arange(a, b) for a, b in bounds]) if len(bounds) else np.zeros(0, np.int64)
                frame = pd.DataFrame({"lang": np.repeat(langs[i:j], sizes)} | {f"c{k}": sym[spots - k].astype(np.int32) for k in range(ORDER)})
                frame = frame.groupby(list(frame.columns), as_index=False).size().rename(columns={"size": "n"})
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    cols = [f"c{k}" for k in range(ORDER)]
    counted = sample.where("fold > 0").select("lang", "text").mapInArrow(count, "lang string, " + ", ".join(f"{c} int" for c in cols) + ", n long")
    table = counted.groupBy("lang", *cols).agg(F.sum("n").alias("n")).orderBy("lang", *cols).toPandas()
    languages = sorted(table.lang.unique().tolist())
    where = {x: k for k, x in enumerate(languages)}
    models = Models(languages, table.lang.map(where).to_numpy(np.int64), table[cols[::-1]].to_numpy(np.int64).reshape(-1, ORDER), table.n.to_numpy(float))
    if languages:
        held = predict(sample.where("fold = 0"), models, text="text", keep=["lang"]).where("lang = lang_pred").groupBy("lang").agg(F.max("bits").alias("most")).collect()
        for r in held:
            models.limit[where[r["lang"]]] = r.most + REJECT_BITS
    return models


def predict(docs: DataFrame, models: Models, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The ``keep`` columns (simple types) with lang_pred, score, bits (per symbol) and rejected.

    A null text or one without letters is ``und`` with score 0 and rejected; so is every text where
    nothing was learned.  Equal entropies go to the first language by name.  The score is the chosen
    language's share of 2 ** -(bits x symbols), with at most 32 symbols counted: 0 to 1.
    """
    frame = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes[1:]) + ", lang_pred string, score double, bits double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [models.entropies(raw, offs) for _, _, raw, offs in text_slices(batch, "_text", PART_BYTES)]
            if not parts:
                continue
            bits, sizes, letters = (np.concatenate(x) for x in zip(*parts, strict=True))
            known = (letters > 0) & (len(models.languages) > 0)
            if models.languages:
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                share = 1 / np.exp2(-(bits - least[:, None]) * np.minimum(sizes, 32)[:, None]).sum(axis=1)
                named, rejected = np.array(models.languages, object)[best], ~known | (least > models.limit[best])
            else:
                least, share, named, rejected = np.zeros(len(bits)), np.zeros(len(bits)), np.full(len(bits), UNKNOWN, object), np.ones(len(bits), bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.where(known, named, UNKNOWN).tolist(), pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, least, 0.0)), pa.array(rejected)],
                [*batch.schema.names[1:], "lang_pred", "score", "bits", "rejected"])

    return frame.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))
