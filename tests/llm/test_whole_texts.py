from docweave.llm import mil_quality as mq


def test_whole_texts_are_learned_from(spark, monkeypatch):
    """The end of a long text reaches the model: all words of a text are there, in their order."""
    seen = {}
    monkeypatch.setattr(mq, "train", lambda words, numbers, y: seen.update(words=words, numbers=numbers, y=y))
    long, short = "plain words " * 4500 + "the very end", "short text"
    mq.fit(spark.createDataFrame([(long, 1), (short, 0), (None, 0)], "text string, quality int"))
    got = {y: [] for y in seen["y"]}
    for y, n in zip(seen["y"], seen["numbers"], strict=True):
        got[y].append(n.tolist())
    number = seen["words"]
    assert got[1.0] == [[number[w] for w in long.split()]]
    assert sorted(got[0.0]) == sorted([[], [number[w] for w in short.split()]])
