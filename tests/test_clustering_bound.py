"""Communities of more documents than one task takes."""

import pytest

from larkspur.operators import clustering as C

SCHEMA = "path string, vector array<float>"


def test_communities_refuse_beyond_the_bound(spark, monkeypatch):
    vectors = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(6)], SCHEMA)
    monkeypatch.setattr(C, "MAX_NODES", 5)
    with pytest.raises(ValueError, match="kmeans"):
        C.communities(vectors)
    monkeypatch.setattr(C, "MAX_NODES", 6)
    assert C.communities(vectors).count() == 6
