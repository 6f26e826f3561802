"""The whole toxicity score against loops that know nothing of tries, cells of Spark or batches."""

import math
import random
import re

import pytest

from groundspark.llm import toxicity as T

BAD = ["grobnik", "flarvel", "zuntmar", "kwelb"]


def texts():
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioust") + r.choice("bdglmnrt") for _ in range(r.randint(1, 4)))
    common = [word() for _ in range(150)]
    rows = []
    for i in range(400):
        w = [r.choice(common) for _ in range(r.randint(0, 30))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randint(0, len(w)), r.choice(BAD))
        text = " ".join(w)
        if i % 40 == 13:
            text = f'they said "{BAD[0]}" ' + text
            toxic = False
        rows.append((i, text, int(toxic)))
    return rows


def edits(a, b):
    t = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, t[0] = t[0], i + 1
        for j, y in enumerate(b):
            last, t[j + 1] = t[j + 1], min(t[j + 1] + 1, t[j] + 1, last + (x != y))
    return t[-1]


def looked(word):
    return word if word.isalpha() else word.translate(T.FOLD) if sum(c.isalpha() for c in word) * 2 > len(word) else word


def found(text):
    return [(m.start(), looked(m.group())) for m in T.WORD.finditer((text or "").lower())]


def stems(w):
    return [w, w[:4] + "*"] if len(w) > 4 else [w]


def gain(toxic, clean, base):
    share = toxic / (toxic + clean)
    if share <= base or share < T.SHARE:
        return -1.0
    return toxic * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0)


def learnt(rows):
    """weights, sure terms and clean words."""
    base = sum(y for _, _, y in rows) / len(rows)
    docs, contexts = {}, {}
    for _, text, y in rows:
        ws = [w for _, w in found(text)]
        for t in {t for w in ws for t in stems(w)}:
            docs.setdefault(t, [0, 0])[y] += 1
        for i, w in enumerate(ws):
            for t in stems(w):
                contexts.setdefault(t, [set(), set()])[y].add(" ".join([*ws[max(0, i - 1) : i], "_", *ws[i + 1 : i + 2]]))
    tried = math.log(max(2, len(docs)))
    weights, sure = {}, set()
    for t, (c, y) in docs.items():
        if gain(y, c, base) <= tried / 2:
            continue
        c, y = map(len, contexts[t])
        if gain(y, c, base) <= tried:
            continue
        always = y >= T.SURE * (y + c)
        if t.endswith("*") and not always:
            continue
        weights[t] = math.log((y + 0.5) / (c + 0.5) * ((1 - base) / base))
        if always and not t.endswith("*") and len(t) > T.SHORT:
            sure.add(t)
    return weights, sure, {t for t, (c, _) in docs.items() if c and not t.endswith("*")}


def cell(x):
    n = x / T.STEP
    return math.ceil(n) if n <= T.EVEN else math.ceil(T.EVEN * (1 + math.log(n / T.EVEN)))


def evidence(text, weights, sure, clean):
    ws = found(text)
    sums = [0.0, 0.0, 0.0]
    for i, (at, w) in enumerate(ws):
        weight = weights.get(w) or (len(w) > 4 and weights.get(w[:4] + "*"))
        misspelt = 0
        if not weight and len(w) >= T.SHORT and w not in clean:
            near = sorted(t for t in sure if edits(w, t) <= 1)
            weight, misspelt = (weights[near[0]], 1) if near else (None, 0)
        if not weight:
            continue
        marks = len(re.findall(f"[{T.QUOTES}]", text[:at]))
        reported = any(v in T.REPORTING for _, v in ws[max(0, i - T.WINDOW) : i + T.WINDOW + 1])
        sums[1 if marks % 2 or reported else 2 if misspelt else 0] += weight
    return [cell(x) for x in sums]


def test_whole_score(spark):
    rows = texts()
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    weights, sure, clean = learnt(rows)
    assert set(weights) == set(model.weights) and all(model.weights[t] == pytest.approx(w) for t, w in weights.items()) and model.sure == sure
    assert sum(b in weights for b in BAD) >= 3 and sure
    odd = ["grobnk here", "a gr0bnik", "flarvell and zuntmar", "he said flarvel", 'no "zuntmar" quoted', "kwel kwelb", "", None, "plain words", "grobnik " * 60, "ZUNTMAR!"]
    asked = rows[:120] + [(1000 + i, t, 0) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(asked, "doc_id long, text string, toxic int"), model).collect()}
    for i, text, _ in asked:
        d, q, m = evidence(text, weights, sure, clean)
        assert (got[i].direct, got[i].quoted, got[i].misspelt) == (d, q, m), text
        z = sum(b * x for b, x in zip(model.coef, [1.0, d * T.STEP, q * T.STEP, m * T.STEP, float(d > 0)], strict=True))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z))) and got[i].predicted == int(got[i].score >= 0.3)
