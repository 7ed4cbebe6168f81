import pytest


@pytest.fixture(autouse=True)
def few_partitions(request):
    """The tables here are small; the operators follow this setting."""
    if "spark" not in request.fixturenames:
        yield
        return
    conf = request.getfixturevalue("spark").conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", "3")
    yield
    conf.set("spark.sql.shuffle.partitions", before)
