"""Random vectors leave most cells open: what the second search sends and brings home, and that it misses nothing."""

import numpy as np

from marketloom.operators import neighbours as NB
from tests.test_neighbours import brute, frame, places


def test_queries_go_to_pages_and_bring_home_few(spark):
    rows = list(enumerate(np.random.default_rng(5).normal(size=(500, 16))))
    df = frame(spark, rows)
    vectors = NB.unit_vectors(df)
    cells, placed = NB.into_cells(vectors)
    asked = vectors.selectExpr("id AS rep", "v")
    again = NB.visits(cells, asked, 3, NB._search(cells, placed, NB.visits(cells, asked, 3), 3))
    assert NB._search(cells, placed, again, 3).count() <= 500 * 3, "not the best three of every cell"
    assert places(NB.nearest_vectors(df, df, 2)) == brute(rows, range(500), 2)
