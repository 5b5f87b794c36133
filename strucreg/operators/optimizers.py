"""Update rules on flat weight vectors.

Each rule maps (weights, gradient, slots, step, rate, decay) to new weights and slots;
everything is elementwise, so weights and slots can be averaged between tasks. The rules are written as moves in place, for the many
small steps of a task: weights and slots are changed, the gradient and ``spare`` are lost. Weights may be one vector, or a row per model
with a step each.
"""

from __future__ import annotations

import math

import numpy as np


def _of_step(f, t):
    """A number that hangs on the step: one, or a column with one per model."""
    return f(t) if np.ndim(t) == 0 else np.array([f(one) for one in t])[:, None]


def _decayed(w, g, decay, spare):
    np.multiply(w, decay, out=spare)
    g += spare


def _sgd(w, g, s, t, lr, decay, spare):
    _decayed(w, g, decay, spare)
    g *= lr
    w -= g


def _mean_square(v, g, keep, take, spare):
    v *= keep
    np.multiply(g, take, out=spare)
    spare *= g
    v += spare


def _rmsprop_dense(w, g, s, t, lr, decay, spare):
    _mean_square(s[0], g, 0.9, 0.1, spare)
    np.add(s[0], 1e-7, out=spare)
    np.sqrt(spare, out=spare)
    g *= lr
    g /= spare
    w -= g


def _rmsprop_graph(w, g, s, t, lr, decay, spare):
    _decayed(w, g, decay, spare)
    _mean_square(s[0], g, 0.99, 0.01, spare)
    np.sqrt(s[0], out=spare)
    spare += 1e-8
    g *= lr
    g /= spare
    w -= g


def _moments(g, s, spare):
    s[0] *= 0.9
    np.multiply(g, 0.1, out=spare)
    s[0] += spare
    _mean_square(s[1], g, 0.999, 0.001, spare)


def _adam_dense(w, g, s, t, lr, decay, spare):
    _moments(g, s, spare)
    np.sqrt(s[1], out=spare)
    spare += 1e-7
    np.multiply(s[0], _of_step(lambda n: lr * math.sqrt(1 - 0.999**n) / (1 - 0.9**n), t), out=g)
    g /= spare
    w -= g


def _adamw_dense(w, g, s, t, lr, decay, spare):
    np.multiply(w, lr * 0.004, out=spare)
    w -= spare
    _adam_dense(w, g, s, t, lr, 0.0, spare)


def _adam_graph(w, g, s, t, lr, decay, spare):
    _decayed(w, g, decay, spare)
    _moments(g, s, spare)
    np.divide(s[1], _of_step(lambda n: 1 - 0.999**n, t), out=spare)
    np.sqrt(spare, out=spare)
    spare += 1e-8
    np.divide(s[0], _of_step(lambda n: 1 - 0.9**n, t), out=g)
    g *= lr
    g /= spare
    w -= g


def _adamw_graph(w, g, s, t, lr, decay, spare):
    w *= 1 - lr * decay
    _adam_graph(w, g, s, t, lr, 0.0, spare)


def _rule(starts: tuple, move) -> tuple:
    """Start values of the slots, the rule that leaves its arguments alone, and the move in place."""

    def rule(w, g, s, t, lr, decay):
        w, s = w.copy(), [v.copy() for v in s]
        move(w, g.copy(), s, t, lr, decay, np.empty_like(w))
        return w, s

    return starts, rule, move


# For the dense networks and for the graph network.
DENSE = {
    "SGD": _rule((), _sgd),
    "RMSprop": _rule((0.0,), _rmsprop_dense),
    "Adam": _rule((0.0, 0.0), _adam_dense),
    "AdamW": _rule((0.0, 0.0), _adamw_dense),
}
GRAPH = {
    "SGD": _rule((), _sgd),
    "RMSprop": _rule((0.0,), _rmsprop_graph),
    "Adam": _rule((0.0, 0.0), _adam_graph),
    "AdamW": _rule((0.0, 0.0), _adamw_graph),
}


def start_slots(rule: tuple, size: int) -> list[np.ndarray]:
    return [np.full(size, v) for v in rule[0]]
