"""Query boxes and locus names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_query(text: str) -> list[str]:
    """Terms of free text, separated by white space or commas."""
    return [t for t in re.split(r"[\s,]+", text) if t]


def locus_name(gene: Column) -> Column:
    """chr_a_b as chr:a-b."""
    return F.regexp_replace(gene, r"^([^_]*)_(\d+)_(\d+)$", "$1:$2-$3")


def peak_name(locus: Column) -> Column:
    """chr:a-b as chr_a_b."""
    return F.regexp_replace(locus, r"^([^:]*):(\d+)-(\d+)$", "$1_$2_$3")
