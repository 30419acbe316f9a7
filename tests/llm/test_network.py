"""The window network's log-probabilities against plain loops over every token."""

import math

import numpy as np

from annalist.llm import lm


def plain_log_prob(net, window, token):
    """log p(token | window) from the parameters, one number at a time."""
    emb, w1, b1, wc, bc, wt, bt = (x.astype(float) for x in net.w)
    x = [v for t in window for v in emb[t]]
    h = [math.tanh(sum(x[i] * w1[i, j] for i in range(len(x))) + b1[j]) for j in range(net.hidden)]

    def log_softmax(z, k):
        most = max(z)
        return z[k] - most - math.log(sum(math.exp(v - most) for v in z))

    c, place = divmod(token, net.per)
    by_class = [sum(h[j] * wc[j, k] for j in range(net.hidden)) + bc[k] for k in range(net.classes)]
    inside = [sum(h[j] * wt[c, j, k] for j in range(net.hidden)) + bt[c, k] for k in range(net.per)]
    return log_softmax(by_class, c) + log_softmax(inside, place)


def test_every_token_from_both_sides(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, n) % 60)) for k, n in enumerate([40, 1, 2, 3, 25])] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = lm.vocabulary(lm.counted_words(docs), 12)
    read = lm.tokenise(docs, tokens)
    net = lm.fit(lm.shards(read, tokens, 71, 30), tokens, 2, batch=16)
    ids = {r.doc_id: np.frombuffer(r.ids, tokens.kind).tolist() for r in read.collect()}
    got = {r.doc_id: r.pll for r in lm.pseudo_likelihood(read, net, tokens).collect()}
    for key, own in ids.items():
        padded = [tokens.border] * lm.REACH + own + [tokens.border] * lm.REACH
        want = sum(plain_log_prob(net, [padded[k + lm.REACH + o] for o in lm.OFFSETS], t) for k, t in enumerate(own))
        assert abs(got[key] - want) < 1e-3 * max(1, len(own))
