"""A literal index: which files can hold a rule's literals, without their text.

Each file has a signature, a Bloom filter of the trigrams of its lower-cased text, sized by their number.  A literal can
only be in a file whose signature has all its trigrams, so a scan with changed rules reads the files that pass and finds
what a scan of all files finds.  The index is slim and made once; a rule without literals, or with shorter ones, passes
the files of its types.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.catalog.model import Rule
from codewarden.functions.paths import basename, rule_extension
from codewarden.operators.matching import applies, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bits of a signature for each distinct trigram, and the fewest; a factor that spreads trigrams.
BITS_PER_TRIGRAM, FEWEST_BITS, FACTOR = 10, 1 << 10, 0x9E3779B97F4A7C15


def trigram_hashes(lowered: str) -> np.ndarray:
    """31-bit hashes of the distinct trigrams of bytes."""
    b = np.frombuffer(lowered.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    grams = np.unique(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:])
    return (grams * np.uint64(FACTOR) >> np.uint64(33)).astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch["lowered"].to_pylist():
            h = trigram_hashes(text)
            size = max(FEWEST_BITS, 1 << (BITS_PER_TRIGRAM * len(h)).bit_length())
            bits = np.zeros(size // 64, np.uint64)
            at = h & (size - 1)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            out.append(bits.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["file_path"], batch["size_bytes"], pa.array(out, pa.list_(pa.int64()))],
                                         ["file_path", "size_bytes", "signature"])


def literal_index(files: DataFrame) -> DataFrame:
    """``file_path, size_bytes, signature`` of each readable file."""
    lowered = files.filter(F.col("code").isNotNull()).select("file_path", "size_bytes", F.lower("code").alias("lowered"))
    return lowered.mapInArrow(_sign, "file_path string, size_bytes long, signature array<long>")


def _may_hold(word: str) -> str:
    tests = [f"(shiftright(element_at(signature, cast(({h} & (64 * size(signature) - 1)) >> 6 as int) + 1), {h} & 63) & 1) = 1"
             for h in trigram_hashes(word.lower()).tolist()]
    return "(" + (" AND ".join(tests) or "true") + ")"


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of the index that any of the rules may match."""
    typed = index.withColumns({"ext": rule_extension(F.col("file_path")), "base": F.lower(basename(F.col("file_path")))})
    tests = [" AND ".join([applies(r), *("(" + " OR ".join(_may_hold(w) for w in words_of(need)) + ")" for need in r.needs)]) for r in rules]
    return typed.filter(F.expr(" OR ".join(f"({t})" for t in tests) or "false")).drop("ext", "base")
