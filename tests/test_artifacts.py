"""What plans write beside their results stays small."""

from pathlib import Path

from docweave.plans import registry
from docweave.sources.tables import resume_tokens, shared_folder


def test_token_artifacts_are_compressed(spark):
    sf_dir = "/root/testdata/sf0.001"
    where = Path(shared_folder(spark).removeprefix("file:"))
    where.mkdir(parents=True, exist_ok=True)
    known = set(where.rglob("part-*"))
    found = registry.QUERIES["src_tokens"](spark, sf_dir)
    files = [p for p in set(where.rglob("part-*")) - known if "artifacts-" in str(p)]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    tokens = resume_tokens(spark, sf_dir)
    assert sum(p.stat().st_size for p in files) < 10 * tokens.count()
    assert sorted(map(str, found.collect())) == sorted(map(str, tokens.select(*found.columns).collect()))


def test_short_lines_meet_by_their_first_words(spark):
    """The pairs of first words of short lines are the same as those told by the general rule."""
    from docweave.operators import alignment as al

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    many = [*words, *(f"{w}{i}" for w in words for i in range(2))]
    rows = [(1, 0, 2 * n, " ".join(many[:n])) for n in range(1, 60)] + [(1, 0, 2 * n + 1, " ".join(many[1:n])) for n in range(2, 60)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_index int, text string")
    truth = lines.filter("line_index % 4 < 2")
    got = {(r.a_line, r.b_line, r.score) for r in al.align_line_jaccard(lines, truth).collect()}
    known = {line: set(t.split(" ")) for _, _, line, t in rows}
    want = set()
    for a, w in known.items():
        best = min(((-len(w & known[b]) / len(w | known[b]), b) for b in known if b % 4 < 2), default=None)
        if -best[0] >= 0.85:
            want.add((a, best[1], round(-best[0], 6)))
    assert got == want
