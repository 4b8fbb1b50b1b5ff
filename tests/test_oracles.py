import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry
import check
from catalog.stopwords import ENGLISH

SF = "/root/testdata/sf0.001"
# The smallest data has no domain with enough documents to scale, and documents without a term of the vocabulary.
LARGER = dict.fromkeys(["standardize", "nearest_centres", "silhouette_of_centres", "project_on", "topic_ranks", "topic_shares"], "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def databases():
    return {d: check.database(d) for d in (SF, *LARGER.values())}


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_result_in_both_engines(spark, databases, name):
    sf_dir = LARGER.get(name, SF)
    result, _ = check.compare(spark, databases[sf_dir], name, sf_dir)
    assert result == "same"


def test_entry_imports_without_the_jars_of_spark(tmp_path):
    """The package as it is, but for its folder of jars."""
    package = Path(pyspark.__file__).parent
    (tmp_path / "pyspark").mkdir()
    for p in package.iterdir():
        if p.name not in ("jars", "__pycache__"):
            (tmp_path / "pyspark" / p.name).symlink_to(p)
    code = "import pyspark, __spark_entry__ as e; print(pyspark.__file__); assert len(e.queries()) > 60 and len(e.oracle_sql()) > 50"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{Path(entry.__file__).parent}"}
    done = subprocess.run([sys.executable, "-B", "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert str(tmp_path) in done.stdout


def test_stop_words_are_those_of_spark(spark):
    assert ENGLISH == StopWordsRemover.loadDefaultStopWords("english")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 116
