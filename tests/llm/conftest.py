import pytest

from ratewright.llm import pii


@pytest.fixture(scope="session")
def models(spark):
    """Trees for personal data, fitted once: without texts, the examples decide."""
    return pii.fit(spark.createDataFrame([], "doc_id long, text string"))
