"""Flat isolation trees give the depths of the nested ones."""

import numpy as np

from tidegauge.operators.models import flat_tree, tree_depths


def test_flat_trees_give_the_depth_of_every_row():
    average = lambda n: n / 10
    tree = (1, 5.0, (0, 2.0, 1, 7), (1, 9.0, 3, (0, 1.0, 2, 4)))
    rows = np.array([[1.0, 1.0], [2.0, 1.0], [0.0, 5.0], [0.0, 9.0], [1.0, 10.0], [np.inf, np.nan]])
    assert tree_depths(flat_tree(tree, average), rows, 3).tolist() == [2 + 0.1, 2 + 0.7, 2 + 0.3, 3 + 0.2, 3 + 0.4, 3 + 0.4]
    assert tree_depths(flat_tree(8, average), rows, 3).tolist() == [0.8] * 6
