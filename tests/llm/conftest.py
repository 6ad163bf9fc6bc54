"""Folders with the awkward tables, with empty ones, and with clashing columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rows import write


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), rows=False)


@pytest.fixture(scope="session")
def clash_dir(spark, tmp_path_factory):
    """The awkward rows with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = "n_words kept base_failed x nth size copies host root texts row fingerprint component_id score rank lang_pred n_scored log_p".split()
    return write(spark, tmp_path_factory.mktemp("clash"), more=lambda df: df.select("*", *(F.lit("extra").alias(n) for n in names)))
