"""Embedding models in a local folder: word vectors that are averaged. Any other model goes in as its own function of a text column.

A folder holds ``vectors.npz`` with ``words`` (strings) and ``matrix`` (a row each).
"""

from __future__ import annotations

import pathlib
import re
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veriledger.errors import IndexError_

FILE = "vectors.npz"


def download_model(source: str, folder: str) -> str:
    """Fetches vectors.npz from a URL (http, https or file) into the folder, which load_embedder() reads; gives the file's path."""
    into = pathlib.Path(folder)
    into.mkdir(parents=True, exist_ok=True)
    try:
        with urllib.request.urlopen(f"{source.rstrip('/')}/{FILE}") as found:
            (into / FILE).write_bytes(found.read())
    except (OSError, ValueError, urllib.error.URLError) as wrong:
        raise IndexError_(f"no model at {source} ({wrong})") from wrong
    return str(into / FILE)


def load_embedder(spark: SparkSession, folder: str) -> Callable[[Column], Column]:
    """The mean of the vectors of a text's known words, at unit length. A missing or damaged model is an IndexError_."""
    path = pathlib.Path(folder) / FILE
    if not path.is_file():
        raise IndexError_(f"no embedding model in {folder}")
    try:
        with np.load(path, allow_pickle=False) as z:
            words, matrix = [str(w) for w in z["words"]], np.asarray(z["matrix"], np.float64)
    except Exception as wrong:  # whatever the reader trips over, the file is no model
        raise IndexError_(f"the embedding model in {folder} cannot be read ({wrong})") from wrong
    if matrix.ndim != 2 or len(words) != len(matrix):
        raise IndexError_(f"the embedding model in {folder} has {len(words)} words and a matrix of shape {matrix.shape}")
    sent = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, matrix))

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        place, vectors = sent.value

        def one(text):
            known = [place[w] for w in re.findall(r"\w+", (text or "").lower()) if w in place]
            v = vectors[known].mean(0) if known else np.zeros(vectors.shape[1])
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed
