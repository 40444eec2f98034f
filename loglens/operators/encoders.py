"""User text encoders (``texts -> vectors``) as iterator pandas UDFs.

``encoder_factory()`` is called once per Python worker (model load) and the
returned function maps a list of strings to a 2-D array-like; batches are
Arrow record batches (``spark.sql.execution.arrow.maxRecordsPerBatch``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.operators.lexical import TOKEN_PATTERN


def encode_column(df: DataFrame, text_col: str, out_col: str, encoder_factory: Callable) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for s in batches:
            v = np.asarray(model(s.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(v))

    return df.withColumn(out_col, enc(F.col(text_col)))


def hashing_encoder(dim: int = 256):
    """Factory of a deterministic dense stand-in encoder: lower-cased word
    counts hashed (crc32) into ``dim`` buckets.  For wiring and tests; a real
    model is passed the same way."""
    import re
    import zlib

    def enc(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                out[i, zlib.crc32(w.encode("utf-8")) % dim] += 1.0
        return out

    return lambda: enc


# ----------------------------------------------------------- feature hashing
# A token's number is the first 32 bits of its MD5; it counts in dimension number % dim, with the sign of the next digit.
def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Feature hashing in JVM expressions: an array of ``dim`` signed token counts (no token: all zero)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    numbers = F.transform(found, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))
    def dimension(d):
        mine = F.filter(numbers, lambda n: n % dim == d)
        return F.aggregate(mine, F.lit(0.0), lambda a, n: a + F.when(F.floor(n / dim) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), dimension)


def signed_hashing_encoder(dim: int = 64):
    """The same vectors as a Python callable, in the form in which a model is passed."""
    import hashlib
    import re

    # letters and numbers of any script, as TOKEN_PATTERN
    tokens = re.compile(r"[^\W_]+")

    def enc(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in tokens.findall((t or "").lower()):
                n = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, n % dim] += 1 if n // dim % 2 == 0 else -1
        return out

    return lambda: enc
