import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Documents of (id, text) or (id, text, source); with columns whose names the operators use themselves."""

    def make(*rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *[7 for _ in extra]) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", `{e}` int" for e in extra))

    return make
