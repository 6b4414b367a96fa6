import numpy as np

from marginalia.plans.matrix import Dense, Identity, Ones


def test_operators_act_like_their_matrices():
    a = np.arange(9.0).reshape(3, 3) + np.eye(3) * 4
    q = 2 * (Dense(a) @ Identity(3)) + Ones(3, 3) - Identity(3)
    want = 2 * a + 1 - np.eye(3)
    x = np.array([1.0, -2.0, 5.0])
    assert np.allclose(q @ x, want @ x) and np.allclose(q.T.dense(), want.T) and np.allclose(q.gram().dense(), want.T @ want)
    assert np.allclose(q.row(1), want[1]) and np.allclose(q.diag(), np.diag(want)) and np.isclose(q.trace(), np.trace(want))
    assert np.isclose(q.l1_sensitivity(), np.abs(want).sum(axis=0).max()) and np.isclose(q.l2_sensitivity(), np.linalg.norm(want, axis=0).max())
    assert np.allclose((q.inverse() @ q).dense(), np.eye(3)) and np.allclose(q.pseudo_inverse().dense(), np.linalg.pinv(want))
    assert np.allclose(Ones(2, 3).T.dense(), np.ones((3, 2)))
