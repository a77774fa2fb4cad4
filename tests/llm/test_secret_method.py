"""What the compression method finds and leaves, measured on planted keys and invented identifiers."""

import random
import string

from wiretide.llm import secret_scan


def spans(text):
    return [(text[s:e]) for s, k, e in secret_scan.novel_spans(text, secret_scan.base_spans(text)) if k == 3]


def test_repeated_keys_are_all_found():
    key = "q7Zk2LmX0vB9tRw4YhNc8sJd"
    text = f"the bearer is {key} and again the bearer is {key} as said"
    assert spans(text) == [key, key]


def test_candidate_is_a_whole_run():
    assert spans("see secretq7Zk2LmX0vB9tRw4YhNc8sJd here") == ["secretq7Zk2LmX0vB9tRw4YhNc8sJd"]


def test_recall_on_planted_keys_and_plain_words():
    pick = random.Random(9)
    words = ["request", "customer", "handler", "service", "internal", "gateway", "profile", "account", "session", "monitor"]
    found = 0
    for _ in range(400):
        key = "".join(pick.choice(string.ascii_letters + string.digits) for _ in range(pick.randrange(20, 41))) + "a1"
        around = " ".join(pick.choice(words) for _ in range(20))
        found += spans(f"{around} bearer {key} {around}") == [key]
    assert found / 400 >= 0.9
    wrong = 0
    for _ in range(200):  # identifiers of words that stand around them, in two spellings
        some = [pick.choice(words) for _ in range(4)]
        for name in ("_".join(some) + "1", "".join(w.title() for w in some) + "1"):
            wrong += spans(" ".join(words) + f" token holder {name} " + " ".join(words)) != []
    assert wrong / 400 <= 0.05


def test_dictionary_of_the_corpus(spark):
    """A name made of the corpus's words is no secret, a key is; nulls and an empty table have no words."""
    rows = [(i, f"the Falcon {i} and the Plankton and a Mangrove Velocity " * 3) for i in range(50)] + [(100, "a secret FalconPlanktonMangrove7 here"), (101, "a secret q7Zk2LmX0vB9tRw4YhNc8sJd here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS count")
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(df).collect()}
    assert got[100] == "" and got[101] == "novel:9:33" and got[None] == "" and len(got) == 53
    assert secret_scan.secret_scan(df.limit(0)).count() == 0
