import numpy as np

from tallyroom.llm import crf


def plain(emission, starts, start, transition):
    n, s = emission.shape
    out = np.zeros((n, s))
    edges = [*np.flatnonzero(starts), n]
    for b, e in zip(edges, edges[1:]):
        forward, backward = np.zeros((e - b, s)), np.zeros((e - b, s))
        forward[0] = start + emission[b]
        for t in range(1, e - b):
            forward[t] = np.log(np.exp(forward[t - 1][:, None] + transition).sum(0)) + emission[b + t]
        for t in range(e - b - 2, -1, -1):
            backward[t] = np.log(np.exp(transition + (emission[b + t + 1] + backward[t + 1])[None, :]).sum(1))
        p = np.exp(forward + backward - (forward + backward).max(1, keepdims=True))
        out[b:e] = p / p.sum(1, keepdims=True)
    return out


def test_marginals_equal_the_plain_recursions():
    rng = np.random.default_rng(1)
    for n, s in ((1, 2), (2, 3), (57, 2), (400, 4)):
        emission, start, transition = rng.normal(size=(n, s)), rng.normal(size=s), rng.normal(size=(s, s))
        starts = rng.random(n) < 0.2
        starts[0] = True
        assert np.allclose(crf.marginals(emission, starts, start, transition)[0], plain(emission, starts, start, transition))
    assert crf.marginals(np.zeros((0, 2)), np.zeros(0, bool), np.zeros(2), np.zeros((2, 2)))[0].shape == (0, 2)


def test_training_learns_words_and_transitions():
    rng = np.random.default_rng(2)
    state = (np.arange(2000) // 5) % 2
    word = np.where(rng.random(2000) < 0.8, state, 2)  # word 2 tells nothing; its neighbours do
    starts = np.arange(2000) % 50 == 0
    weight, start, transition = crf.train(word, np.arange(2001), state, starts, 3, 2)
    p = crf.marginals(weight[word].astype(float), starts, start, transition)[0]
    assert ((p[:, 1] > 0.5) == state).mean() > 0.9
    assert transition[0, 0] > transition[0, 1] and transition[1, 1] > transition[1, 0]
