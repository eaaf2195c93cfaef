import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def make(spark):
    """``make(columns, rows)``: a small frame, in two partitions when it has rows."""

    def build(schema, rows):
        return spark.createDataFrame(rows, schema).repartition(2) if rows else spark.createDataFrame([], schema)

    return build


@pytest.fixture
def prose():
    import random

    def text(seed, n=60):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return text


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, lang string, source string, n_chars long, rid string, key string, label int, score string, size string, _place string, places string, fp string"


@pytest.fixture
def doc_rows(prose):
    def rows(texts):
        return [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]

    return rows
