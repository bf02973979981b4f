import pytest

from . import fixtures


@pytest.fixture(scope="session")
def docs(spark):
    return fixtures.documents(spark).repartition(4).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]
