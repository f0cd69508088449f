"""64-bit perceptual hashes as hex text, hashes of texts, and a text embedding by hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_half(x: Column | str, start: int) -> Column:
    return F.conv(F.substring(x, start, 8), 16, 10).cast("long")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hex texts of up to 16 digits; 64 where their lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    bits = lambda s: F.bit_count(F.coalesce(hex_half(a, s), F.lit(0)).bitwiseXOR(F.coalesce(hex_half(b, s), F.lit(0))))
    return F.when(F.length(a) != F.length(b), 64).otherwise(bits(1) + bits(9)).cast("int")


def bands(x: Column | str, distance: int = 6) -> Column:
    """Blocks (number, digits) of a 16-digit hash; two hashes within ``distance`` bits share one at least."""
    n = distance + 1
    cut = [round(i * 64 / n) for i in range(n + 1)]
    x = F.col(x) if isinstance(x, str) else x
    binary = F.concat(*[F.lpad(F.conv(F.substring(x, i, 8), 16, 2), 32, "0") for i in (1, 9)])
    return F.array(*[F.struct(F.lit(i).alias("block"), F.substring(binary, cut[i] + 1, cut[i + 1] - cut[i]).alias("digits")) for i in range(n)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """64 dimensions of signed FNV-1a hashes of words, scaled to length 1, of texts that are already normalised."""
    out = []
    for t in text:
        v = np.zeros(64)
        for word in (t or "").split():
            h = 2166136261
            for unit in np.frombuffer(word.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
                h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
            h = h - (1 << 32) if h >= 1 << 31 else h
            v[abs(h) % 64] += 1.0 if h % 2 == 0 else -1.0
        length = np.sqrt((v * v).sum())
        out.append((v / length if length else v).tolist())
    return pd.Series(out)


def sha256_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts, null as empty, joined by a character that texts don't hold."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def djb2(x: Column | str) -> Column:
    """The djb2 hash of a text's code points as an unsigned 32-bit number."""
    points = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(points, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseXOR(c.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
