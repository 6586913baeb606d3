import random

import numpy as np
import pytest

from chronofold.llm import toxicity as X
from chronofold.llm.tokens import count_tokens

CALM = ["The notice was posted on {d} May and reached the carrier late", "Counsel accepted that the valuation of {d} crowns could not stand", "The dog is a bitch of {d} months, well trained", "Nothing in the cited ruling compels a different conclusion", "The vermin contract expires in {d} days", "you will hear from my lawyers"]
FOUL = ["you are all rotten {x} in that office", "crawl back to your hole, you {x}", "shut your mouth, you filthy {x}", "the only good islanders are the {x} in the ground"]
SLUR = ["scumbag", "bastard", "parasite", "cretin", "moron"]
FRAMES = ["[reader comment] {p}.", "A note pinned to the gate said '{p}'.", "The caller then said: {p}!"]


def _doc(r, foul):
    parts = [r.choice(CALM).format(d=r.randint(1, 99)) + "." for _ in range(r.randint(3, 15))]
    p = r.choice(FOUL).format(x=r.choice(SLUR)) if foul else r.choice(CALM).format(d=1)
    parts.insert(r.randrange(len(parts)), r.choice(FRAMES).format(p=p))
    return "\n".join(parts)


def _corpus(n, share, seed):
    r = random.Random(seed)
    truth = [r.random() < share for _ in range(n)]
    return [_doc(r, t) for t in truth], truth


def test_held_out_accuracy():
    texts, truth = _corpus(1500, 0.08, 1)
    confirmed = [t for t, y in zip(texts, truth) if y][:50] + [t for t, y in zip(texts, truth) if not y][:6]  # some readers err
    model, held = X.fit(confirmed, texts)
    fresh, want = _corpus(1500, 0.08, 2)
    score = model.score(fresh, X._Ids())
    edge, count = np.unique(np.floor(score * 20) / 20, return_counts=True)
    got = score >= X.threshold(held, edge, count)
    want = np.array(want)
    assert (got & want).sum() / want.sum() > 0.9 and (got & want).sum() / got.sum() > 0.9


def test_disguises_are_undone():
    ids = X._Ids()
    first = X.passages(["you filthy bastard"], ids)[0].tolist()
    for t in ("YOU filthy b a s t a r d", "you filthy bаstаrd", "you filthy bas​tard", "you filthy b4st4rd", "you filthyyy baastarrrd", "you ｆilthy bastard"):
        assert X.passages([t], ids)[0].tolist() == first, t


def test_passages_and_empty_texts():
    h, first, owner = X.passages(["One two. Three", None, "", "...", "four"], X._Ids())
    assert len(h) == 4 and first.tolist() == [0, 2, 3] and owner.tolist() == [0, 0, 4]
    m = X.Classifier(np.zeros(1 << X.BITS), -1.0)
    assert m.score(["a b", None, "", "!!", "x" * 200_000], X._Ids()).tolist() == [-1.0, X.EMPTY, X.EMPTY, X.EMPTY, -1.0]


def test_non_negative_risk_keeps_positives_apart():
    bags = X._Bags(["foul words here", "calm words there", "calm talk"])
    score = lambda m: bags.scores(*m)
    p = np.array([int(bags.passage[bags.text == 0][0])])
    s = score(X.nnpu(bags, p, np.arange(bags.n), np.ones(bags.n), 0.3))
    assert s[p[0]] > max(np.delete(s, p[0]))


def test_scores_query_shape(spark):
    texts, truth = _corpus(300, 0.1, 3)
    docs = [(i, t, "src") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "SRC "), (None, "you moron", "src"), (5, texts[5], "src")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as score", "2 as mean_")
    labels = spark.createDataFrame([(i, "r", int(truth[i])) for i in range(200)] + [(i, "q", None) for i in range(50)] + [(None, "r", 1)], "doc_id bigint, rater string, abusive int")
    out = X.scores(d, labels, keep=("source",))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == set(range(300)) | {900, 901} and out.count() == 302
    assert rows[900]["score"] == X.EMPTY and not rows[901]["flagged"]
    hit = sum(rows[i]["flagged"] and truth[i] for i in range(300))
    assert hit / sum(truth) > 0.8 and hit / sum(r["flagged"] for r in rows.values()) > 0.8
    assert {r["source"]: r["n_documents"] for r in X.rates(out).collect()} == {"src": 301, "": 1}
    assert X.scores(d, labels.limit(0)).where("flagged").count() == 0
    assert X.scores(d.limit(0), labels).count() == 0


def test_token_counts(spark):
    from pathlib import Path

    from chronofold.llm import tokens

    if not Path(tokens.VOCABULARY).exists():
        pytest.skip("no vocabulary file")
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 50_000), (5, "x" * 100_000), (6, "<|endoftext|> é漢字")]
    got = {r["id"]: r["n_tokens"] for r in count_tokens(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] >= 50_000 and got[5] > 0 and got[6] > 3


def test_share_is_no_finer_than_the_sample():
    calm, _ = _corpus(400, 0.0, 5)
    foul, _ = _corpus(60, 1.0, 6)
    _, held = X.fit(foul, calm)  # most confirmed texts outscore every unlabelled one
    assert held.min() >= 1 / 400
    edges, counts = np.arange(100) / 20, np.full(100, 50_000.0)  # 5 million documents
    counts[-20:] = np.r_[np.full(19, 2_500.0), 1.0]
    flagged = counts[edges >= X.threshold(held, edges, counts)].sum()
    assert flagged >= counts.sum() / 400 / 2


def test_a_rare_family_of_short_passages_is_found():
    r = random.Random(8)
    calm, _ = _corpus(1500, 0.0, 9)
    foul, _ = _corpus(200, 1.0, 10)
    rare = [_doc(r, False) + "\nHe wrote: begone, sir" for _ in range(12)]
    errors, _ = _corpus(60, 0.0, 11)  # readers err
    model, held = X.fit(foul + rare + errors, calm + foul[:40] + rare[:4])
    score = model.score([_doc(r, False) + "\nShe cried: begone" for _ in range(20)] + _corpus(300, 0.0, 12)[0], X._Ids())
    assert np.median(score[:20]) > np.quantile(score[20:], 0.99)
    assert 0.02 < X.share_to_flag(held) < 0.05


def test_few_or_empty_confirmed_texts():
    calm, _ = _corpus(50, 0.0, 3)
    for confirmed in (["you filthy moron"], ["..."], ["...", "you filthy moron"], []):
        model, held = X.fit(confirmed, calm)
        assert len(held) in (0, len(confirmed)) and np.isfinite(model.score(calm, X._Ids())).all()
    assert X.threshold(X.fit(["you filthy moron"], ["", "..."])[1], np.array([0.0]), np.array([1.0])) == np.inf
