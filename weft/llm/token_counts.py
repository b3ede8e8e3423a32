"""Token counts through a digest cache.

Texts are reduced to (digest of the normalised content, version of the tokenizer). Distinct digests are
joined to the stored counts; only those that are missing are encoded, once each, and appended to the cache.
Texts of one normalised content, however many, cost one encoding. Content is normalised by the tokenizer's own
normalizer, which takes a text to a form that is encoded alike; a text that holds one of its special strings, which are looked for before
that, and any text of a tokenizer without a normalizer stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weft.llm.common import Scratch, batch_of, pick, shared_dir, worker_cache

COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
# Characters on whose classes all regex engines agree; other texts go through the library itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€]*")
ODD_SPACE = re.compile(r" [\t\n\r ]|[\t\n\r] ")
CACHED_PIECES = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies, as published with that scheme."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens exactly as the tokenizer file's library does, special strings included.

    Byte-level BPE files are run through an equivalent merge table, piece by piece with a memory: a single
    space between visible characters always begins a new piece, so a text's count is the sum over its
    space-separated pieces. Whatever isn't covered by that argument is given to the library whole.
    """

    def __init__(self, path: str):
        self.path, self.memory, self.merge, self.special = path, {}, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda t: len(self.piece.encode(t))
            self.names, self.form = [], None  # its normalizer also splits symbols off, so texts are digested as they are
            return
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.library = lambda t: len(self.own.encode(t, add_special_tokens=False).ids)
        self.merge, self.special = merge_table(self.own)
        self.names = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.form = self.own.normalizer.normalize_str if self.own.normalizer else None

    def __call__(self, text: str) -> int:
        if self.merge is None or not PLAIN.fullmatch(text):
            return self.library(text) if text else 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)

    def normalised(self, text: str) -> str:
        if self.form is None:
            return text
        low, done = text.lower(), self.form(text)
        if any(n.lower() in low or n in done for n in self.names):
            return "\0raw " + text  # not a form of any other text
        return done

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if ODD_SPACE.search(text):
            return len(self.merge(text))
        memory, total = self.memory, 0
        head, *rest = text.split(" ")
        if head:
            total = len(self.merge(head))
        for word in rest:
            n = memory.get(word)
            if n is None:
                n = len(self.merge(" " + word))
                if len(memory) < CACHED_PIECES and len(word) < 40:
                    memory[word] = n
            total += n
        return total


def merge_table(own):
    """(encode, pattern of special strings) for a plain byte-level BPE; (None, None) for anything else."""
    import json

    import tiktoken

    spec = json.loads(own.to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens") or []
    simple = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE"
    simple = simple and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk", "byte_fallback"))
    simple = simple and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if not simple:
        return None, None
    bytes_of, names = byte_alphabet(), {t["content"] for t in added}
    vocab = {k: v for k, v in model["vocab"].items() if k not in names}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
        return None, None
    ranks = {bytes(bytes_of[c] for c in k): v for k, v in vocab.items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    table = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return table.encode_ordinary, re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None


def counter(path: str) -> Counter:
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        cache["tokenizer", path] = Counter(path)
    return cache["tokenizer", path]


def normalises(path: str) -> bool:
    return not path.endswith(".model") and counter(path).form is not None


@functools.cache
def version(path: str) -> str:
    """Of the tokenizer: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cache_path: str | None = None) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file that every worker can read. cache_path: folder of
    the stored counts, kept and used again; None: a new one in the shared scratch folder for this call.
    Nulls: a null text counts as empty, with 0 bytes and tokens; null ids and repeated rows are kept, each
    row with its count. Whole texts are counted, whatever their length. Other columns are ignored; an
    empty table gives an empty result and adds nothing to the cache.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    home = f"{cache_path or f'{shared_dir(spark)}/weft-token-cache-{uuid.uuid4().hex}'}/{version(tokenizer)}"
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def forms(batches):
        form = counter(tokenizer).normalised
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hashlib.sha256(form(x.as_py()).encode("utf-8", "surrogatepass")).digest() for x in b.column(1)], pa.binary())], names=["id", "text", "digest"])

    if normalises(tokenizer):
        rows = rows.mapInArrow(forms, f"id {rows.schema['id'].dataType.simpleString()}, text string, digest binary")
    else:
        rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = scratch.cut(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    wanted = keys.groupBy("digest").agg(F.min("id").alias("first"))
    try:
        wanted = wanted.join(spark.read.parquet(home).select("digest"), "digest", "left_anti")
    except AnalysisException:
        pass  # no such cache yet

    def encode(batches):
        count = counter(tokenizer)
        for b in batches:
            digests, texts = b.column(0).to_pylist(), b.column(1)
            seen: dict[bytes, int] = {}
            for i, d in enumerate(digests):
                if d not in seen:
                    seen[d] = count(texts[i].as_py())
            yield batch_of(COUNTS, list(seen.items()))

    wanted = wanted.withColumnRenamed("digest", "d")
    missing = rows.join(wanted.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("first")))
    found = missing.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    found.write.mode("append").parquet(home)
    stored = spark.read.schema("digest binary, n_tokens long").parquet(home).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    done = keys.join(stored, "digest")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
