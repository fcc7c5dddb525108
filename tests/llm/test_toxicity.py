import math
import random
import re
import zlib

import pytest

from kelpie.llm import toxicity as T


def labelled(spark, n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), "zwurk" + rng.choice(["el", "at", "osch", "im"]))
        docs.append((i, ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))))
        labels.append((i, int(toxic)))
    extra = [(n, None), (n + 1, ""), (None, "idiot"), (0, docs[0][1])]
    return spark.createDataFrame(docs + extra, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int"), dict(labels)


def test_learns_word_beginnings_and_holds_on_the_held_out_fold(spark):
    docs, labels, truth = labelled(spark)
    model = T.fit(docs, labels)
    assert any(k.startswith("zwur") for k in model.lexicon)
    out = T.score_documents(docs, labels).collect()
    assert len(out) == 604
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_clauses_not_words():
    g = T.Grammar(dict.fromkeys(T.INSULTS, 1.0))
    kind = lambda s: [T.KINDS[k] for _, _, k, _ in g.clauses(s)]
    assert kind("What an idiot. Fine weather.") == ["plain"]
    assert kind("You are an idiot") == ["aimed"]
    assert kind("You are not an idiot") == ["denied"]
    assert kind("She said he called me an idiot") == ["quoted"]
    assert kind("I will kill you; not you") == ["threat"]
    assert kind("They kill time") == ["threat"] and kind("We kill time") == []
    assert kind("I will not hurt you") == ["weak_threat"]
    assert kind("unidiotic") == [] and kind("") == [] and kind("İdiot IDIOT") == ["plain"]


def test_automaton_composes_its_parts():
    step, kind = T.compose()
    assert len(step) == len(kind) == 3 * 2 * (T.REACH + 2) * 3
    assert all(0 <= s < len(step) for row in step for s in row)


def test_without_labels_and_empty(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, none)
    assert set(model.lexicon) == set(T.INSULTS)
    assert T.score_documents(empty, none).collect() == []


def test_keep_below_keeps_all_columns(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = T.keep_below(docs, T.fit(docs, none), 0.5)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_words_that_only_meet_others_are_learnt(spark):
    """Every toxic text of "blorfig" also holds a more frequent abuse word; a text that holds it alone is toxic."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(300)}x" for _ in range(20)]
        toxic = i % 5 == 0
        if toxic:
            words += ["zwurkel"] + ["blorfig"] * (i % 10 == 0)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, "w1x blorfig w2x"), (5001, "w1x w2x")]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in T.score_documents(docs, labels).where("doc_id >= 5000").collect()}
    assert found == {5000: 1, 5001: 0}


def test_choice_asks_for_evidence_not_for_a_size_of_table():
    rivals = {4: 10, 40: 10, 62: 10}
    for n_toxic in (150, 250):
        assert set(T.choose({"abus": (4, 0), "half": (20, 20)}, rivals, n_toxic, 4000)) == {"abus"}
    assert T.choose({"chan": (4, 0)}, {4: 100_000}, 400, 3000) == {}
    # "loser" is abuse, what else begins with "lose" is not; "tras" and "trash" are the same texts.
    assert set(T.choose({"lose": (50, 12), "loser": (40, 0), "tras": (40, 0), "trash": (40, 0)}, rivals, 300, 3000)) == {"loser", "tras"}


def plain_score(model, text):
    """A clause scorer without automata: sets, slices and the rules as said."""
    kinds = {}
    for clause in re.split(r"[.!?;:\n\r]+", (text or "").lower()):
        words = re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause)
        sort, weight = [], []
        for w in words:
            fixed = next((name for name, known in (("target", T.TARGETS), ("negation", T.NEGATIONS), ("threat", T.THREATS), ("report", T.REPORTS)) if w in known), None)
            heads = [model.lexicon[w + "$"]] if w + "$" in model.lexicon else [model.lexicon[w[:n]] for n in range(len(w), 0, -1) if w[:n] in model.lexicon][:1]
            sort.append(fixed or ("insult" if heads else "other"))
            weight.append(1.0 if fixed else heads[0] if heads else 0.0)
        hits = [i for i, s in enumerate(sort) if s in ("insult", "threat")]
        if not hits:
            continue
        insult, aimed = "insult" in sort, "target" in sort
        # A negation reaches three words, and one that met abuse is spent.
        weak, reach = False, 0
        for s in sort:
            if s == "negation":
                reach = 3
            elif s in ("insult", "threat"):
                weak, reach = weak or reach > 0, 0
            else:
                reach = max(0, reach - 1)
        quoted = any(s == "report" and any(h > i for h in hits) for i, s in enumerate(sort))
        kind = ("denied" if weak else "quoted" if quoted else "aimed" if aimed else "plain") if insult else ("weak_threat" if weak or quoted else "threat") if aimed else None
        if kind:
            kinds.setdefault(kind, []).append(max(weight[i] for i in hits))
    z = model.bias + sum(model.weights[T.KINDS.index(k)] * max(w) * (1 + 0.1 * math.log2(len(w))) for k, w in kinds.items())
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_scorer(spark):
    docs, labels, _ = labelled(spark)
    model = T.fit(docs, labels)
    model = T.Model(model.lexicon | {"zap$": 0.8}, model.weights, model.bias)
    rng = random.Random(8)
    words = ["idiot", "idiots", "kill", "you", "not", "said", "fine", "weather", "zap", "zappy", "zwurkel", "they", "never", "wrote", "hurt", "stupid"]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    texts += [r.text for r in docs.limit(50).collect()] + [None, "", "İdiot", "IDIOT!", "you\nkill"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.score(frame, model, "doc_id").collect():
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9), texts[r.doc_id]


def test_whole_words_of_any_length_are_learnt(spark):
    """Abuse of three letters, and abuse that differs from a clean word only after its ninth letter."""
    rng = random.Random(6)
    docs = []
    for i in range(900):
        words = [f"w{rng.randrange(300)}x" for _ in range(15)] + ["zug"[: 3 - (i % 2)] + "o", "incomprehensible"]
        docs.append((i, " ".join([*words, *(["zug"] if i % 6 == 0 else ["incomprehensiblo"] if i % 6 == 3 else [])])))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    docs += [(5000, "w1x zug"), (5001, "w1x incomprehensiblo"), (5002, "zugo incomprehensible")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(spark.createDataFrame([(None, "zug")], "doc_id long, text string"))
    found = {r.doc_id: (r.predicted, r.held_out) for r in T.score_documents(frame, labels).where("doc_id IS NULL OR doc_id >= 5000").collect()}
    assert {d: p for d, (p, _) in found.items()} == {5000: 1, 5001: 1, 5002: 0, None: 1} and found[None][1] is False
