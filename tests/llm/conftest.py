from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
CLASH = "id int, fp string, part string, src string, h string, seg int, size int, key string, host string, path string, n int, _n int, score string, kept string, bad string, _id int"


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]), with further columns that clash."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if clash:
            n = len(CLASH.split(", "))
            full = [f + (None,) * n for f in full]
            schema += ", " + CLASH
        return spark.createDataFrame(full, schema)

    return make
