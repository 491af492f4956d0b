"""Quality rules on how a public tokenizer's vocabulary takes a text, within bands of its language or script."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, portions, stored

#: Where vocabularies of public tokenizers are, on every executor.
VOCABULARIES = "/opt/tokenizers"
#: The first code point of each range of scripts that letters are counted by.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "other"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Indic"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD800, "other"),
    (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
)
_FIRST = np.array([a for a, _ in SCRIPTS], np.int64)
_NAMES = sorted({b for _, b in SCRIPTS})
_CLASS = np.array([_NAMES.index(b) for _, b in SCRIPTS], np.int64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
MEASURES = ("chars_per_token", "byte_share", "token_entropy")


def load_vocabulary(path: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """A function from texts to token ids, and for each id whether it is a byte that stands for part of a character.

    *.model: sentencepiece, whose byte pieces are what it falls back on. *.tiktoken: ranks of byte-level pairs; single bytes from 128 on are the parts.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1), np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    parts = np.zeros(max(ranks.values()) + 1, bool)
    parts[[i for x, i in ranks.items() if len(x) == 1 and x[0] >= 128]] = True
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [own.encode_ordinary(x) for x in texts], parts


def repeated_windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Whether each place lies in a window of `width` ids that is found twice or more. Only windows all of whose neighbouring pairs are found twice can be; few are."""
    out = np.zeros(len(ids), bool)
    if len(ids) < width:
        return out
    _, pair, met = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True, return_counts=True)
    upto = np.concatenate([[0], np.cumsum(met[pair] > 1)])
    start = np.flatnonzero(upto[width - 1 :] - upto[: len(upto) - width + 1] == width - 1)
    if len(start):
        _, name, met = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width)[start], axis=0, return_inverse=True, return_counts=True)
        twice = start[met[name.ravel()] > 1]
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + width, -1)
        out = np.cumsum(mark[:-1]) > 0
    return out


def base_counts(texts: list[bytes], width: int = 8) -> tuple[list[list[bytes]], dict[str, np.ndarray]]:
    """Each text's words, and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    found = [x.split() for x in texts]  # bytes split at space and \t to \r
    n_words = np.array([len(x) for x in found], np.int64)
    chars, symbols, dup = (np.zeros(len(texts), np.int64) for _ in range(3))
    coded = pa.array([w for x in found for w in x], pa.binary()).dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        chars[i] = np.count_nonzero((data & 0xC0) != 0x80) - np.count_nonzero(_BLANK[data])
        symbols[i] = len(text) - len(text.translate(None, b"#*$%&|<>"))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    of = np.repeat(np.arange(len(texts)), n_words)
    # a word's name holds its text, so windows of two texts, or over the end of one, are never equal
    again = repeated_windows(of * max(1, known) + ids, width)
    counts = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup}
    return found, counts | {"n_repeat_words": np.bincount(of[again], minlength=len(texts)).astype(np.int64)}


def window_entropy(tokens: np.ndarray, of: np.ndarray, n: int, window: int) -> np.ndarray:
    """For each of n texts the mean over its tokens of their window's entropy, as a share of the most that a window of so many tokens can have (a window
    of one token: 1). Windows do not overlap; of gives each token's text, in order."""
    size = np.bincount(of, minlength=n)
    nth = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
    new = np.r_[True, (of[1:] != of[:-1]) | (nth[1:] % window == 0)] if len(tokens) else np.zeros(0, bool)
    in_window = np.cumsum(new) - 1
    text_of = of[new]
    width = np.bincount(in_window)
    pair, times = np.unique(in_window * (int(tokens.max(initial=0)) + 1) + tokens, return_counts=True)
    held = np.bincount(pair // (int(tokens.max(initial=0)) + 1), times * np.log2(times), len(width))
    share = np.where(width > 1, (np.log2(np.maximum(width, 2)) - held / np.maximum(width, 1)) / np.log2(np.maximum(width, 2)), 1.0)
    return np.bincount(text_of, share * width, n) / np.maximum(size, 1)


def scripts(texts: list[bytes]) -> list[str | None]:
    """The script of most of a text's letters beyond ASCII punctuation and digits; None without such."""
    out: list[str | None] = []
    for text in texts:
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        letters = points[(points >= 128) | ((points | 32) - 97 < 26)]
        out.append(_NAMES[int(np.bincount(_CLASS[np.searchsorted(_FIRST, letters, "right") - 1]).argmax())] if len(letters) else None)
    return out


def measured(docs: DataFrame, vocabularies: Sequence[str], folder: str = VOCABULARIES, text: str = "text", window: int = 128, block_words: int = 4096) -> DataFrame:
    """docs without the text, with the base counts, the script, and for the k-th vocabulary n_tokens_k and each measure as NAME_k.

    Texts are tokenized as their words with single spaces between, in blocks of words: pieces never go over a space, so that blocks change nothing.
    chars_per_token are code points of words over tokens, byte_share the share of tokens that are parts of characters, token_entropy as window_entropy
    has it. Without tokens they are null.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [(c, T.LongType()) for c in counts] + [("script", T.StringType())]
    for k in range(len(vocabularies)):
        fields += [(f"n_tokens_{k}", T.LongType())] + [(f"{m}_{k}", T.DoubleType()) for m in MEASURES]
    others = docs.drop(text, *(c for c, _ in fields))
    names = others.columns
    schema = T.StructType([*others.schema.fields, *(T.StructField(c, t) for c, t in fields)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [load_vocabulary(os.path.join(folder, v)) for v in vocabularies]
        for batch, texts in (x for whole in batches for x in portions(whole, text)):
            found, base = base_counts(texts)
            columns = [*(batch.column(c) for c in names), *(pa.array(base[c]) for c in counts), pa.array(scripts(texts), pa.string())]
            blocks = [b" ".join(x[k : k + block_words]).decode("utf-8", "replace") for x in found for k in range(0, len(x), block_words)]
            in_block = np.repeat(np.arange(len(texts)), [-(-len(x) // block_words) for x in found])
            for encode, parts in loaded:
                ids = encode(blocks)
                sizes = [len(x) for x in ids]
                tokens = np.fromiter((i for x in ids for i in x), np.int64, sum(sizes))
                of = np.repeat(in_block, sizes)
                n = np.bincount(of, minlength=len(texts)).astype(np.int64)
                none = n == 0
                some = np.maximum(n, 1)
                share = np.bincount(of, parts[tokens] if len(tokens) else None, len(texts)) / some
                columns.append(pa.array(n))
                columns += [pa.array(x, pa.float64(), mask=none) for x in (base["word_chars"] / some, share, window_entropy(tokens, of, len(texts), window))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*names, text).mapInArrow(measure, schema)


def _deviation(measure: str, k: int, sure_tokens: int) -> Column:
    """How far a measure lies from the centre, in units that short and long texts share: times the square root of the tokens, up to sure_tokens."""
    return (F.col(f"{measure}_{k}") - F.col(f"centre_{measure}_{k}")) * F.sqrt(F.least(F.col(f"n_tokens_{k}"), F.lit(sure_tokens)).cast("double"))


def fit_bands(rows: DataFrame, vocabularies: int, least_documents: int, sure_tokens: int) -> DataFrame:
    """(kind, name, n, and for each measure its centre and the quartiles of its deviation), over all rows: by language, by script, and of all.

    Measures are rounded, to a thousandth and deviations to a hundredth, so that a quartile is found over a bounded number of values and is exact of them.
    """
    key = F.explode(
        F.array(F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("name")), F.struct(F.lit("script").alias("kind"), F.col("script").alias("name")), F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")))
    )
    each = [(m, k) for k in range(vocabularies) for m in MEASURES]
    keyed = rows.select("*", key.alias("band")).select("*", "band.kind", "band.name").where("name is not null")
    centres = [F.percentile(F.round(f"{m}_{k}", 3), 0.5).alias(f"centre_{m}_{k}") for m, k in each]
    centre = stored(keyed.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), *centres).where(F.col("n") >= least_documents), "centres")
    spread = [F.percentile(F.round(_deviation(m, k, sure_tokens), 2), [0.25, 0.75]).alias(f"quartiles_{m}_{k}") for m, k in each]
    around = keyed.join(centre, ["kind", "name"]).groupBy("kind", "name").agg(*spread)
    return centre.join(around, ["kind", "name"])


def fertility_rules(
    docs: DataFrame,
    vocabularies: Sequence[str] = ("piece_bpe_32k.model",),
    folder: str = VOCABULARIES,
    text: str = "text",
    lang: str = "lang",
    least_words: int = 20,
    repeat_percent: int = 30,
    fence: float = 3.0,
    margins: Sequence[float] = (1.5, 0.5, 0.3),
    least_documents: int = 30,
    sure_tokens: int = 1024,
    window: int = 128,
) -> DataFrame:
    """docs without the text, with counts of words, symbols and repeats, base_failed, each vocabulary's measures, rejected_by and kept.

    A text fails the base rules with under least_words words or over repeat_percent % of them in eight-word windows found twice or more. Of the others, one
    is rejected whose characters per token, share of byte tokens or entropy of tokens lies outside the band of its language: `fence` times the distance
    of the quartiles, or the measure's margin if that is more, beyond the quartiles. Deviations count times the square root of a text's tokens, up to
    sure_tokens, as a short text's measure scatters by that. Few byte tokens are never a fault, and nor is high entropy. The bands come from all texts that pass the
    base rules; a language of under least_documents of those takes its script's band, a script of under so many that of all, and if there are fewer in
    all, nothing is rejected.

    Nulls: a null text is empty and fails the base rules; a null language goes by script. Very long texts are tokenized in blocks, whole. Repeated rows count
    as documents each. Other columns pass through; those named like the added ones are replaced. Empty table: no rows.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", "rejected_by", "kept"]
    added += [f"{x}_{k}" for k in range(len(vocabularies)) for x in ("n_tokens", *MEASURES)]
    others = [c for c in docs.columns if c.lower() not in (*added, text.lower())]
    whole = docs.select(F.struct(*others).alias("doc"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = stored(measured(whole, vocabularies, folder, window=window).withColumn("base_failed", failed), "fertility")
    bands = stored(fit_bands(rows.where(~F.col("base_failed")), len(vocabularies), least_documents, sure_tokens), "bands")
    own = bands.where("kind = 'lang'").select(F.col("name").alias("lang"), F.struct(*bands.columns).alias("by_lang"))
    # a row for each script that SCRIPTS names, and one for all
    script = bands.where("kind = 'script'").select(F.col("name").alias("script"), F.struct(*bands.columns).alias("by_script"))
    every = bands.where("kind = 'all'").select(F.struct(*bands.columns).alias("of_all"))
    joined = rows.join(own, "lang", "left").join(F.broadcast(script), "script", "left").join(F.broadcast(every), F.lit(True), "left")
    band = free_name(rows, "band")
    joined = joined.withColumn(band, F.coalesce("by_lang", "by_script", "of_all"))
    faults = []
    for k in range(len(vocabularies)):
        for m, margin in zip(MEASURES, margins, strict=True):
            off = (F.col(f"{m}_{k}") - F.col(band)[f"centre_{m}_{k}"]) * F.sqrt(F.least(F.col(f"n_tokens_{k}"), F.lit(sure_tokens)).cast("double"))
            low, high = F.col(band)[f"quartiles_{m}_{k}"][0], F.col(band)[f"quartiles_{m}_{k}"][1]
            reach = F.greatest(fence * (high - low), F.lit(float(margin)))
            under, over = off < low - reach, off > high + reach
            faults.append(F.when({"chars_per_token": under | over, "byte_share": over, "token_entropy": under}[m], f"{m}_{k}"))
    rejected = F.when(~F.col("base_failed"), F.array_compact(F.array(*faults))).otherwise(F.array().cast("array<string>"))
    out = joined.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return out.select(*[F.col("doc")[c].alias(c) for c in others], *added)


def op12_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = fertility_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
