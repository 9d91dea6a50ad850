import pytest

from gainsay.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    importable(spark)


@pytest.fixture
def documents(spark):
    """Builds documents from texts; ids count from 0 unless given."""
    def build(texts, ids=None, schema=SCHEMA):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], schema).repartition(3)
    return build
