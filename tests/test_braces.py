import random

from auditweave.operators.braces import block_spans, line_depths


def test_spans_and_depths_against_a_stack(spark):
    rng = random.Random(8)
    files = [(f"f{i}", "".join(rng.choice("{{}}a \n") for _ in range(rng.randrange(80)))) for i in range(80)] + [("none", None), ("deep", "{" * 3000 + "\n" + "}" * 3000)]
    df = spark.createDataFrame(files, "file string, text string")
    want, depths = set(), set()
    for f, t in files:
        if t is None:
            continue
        depth, opened, line = 0, {}, 1
        for at, c in enumerate(t):
            if c == "{":
                depth += 1
                opened[depth] = (at, line, depth)
                want.add((f, at, None, line, None, depth))
            elif c == "}":
                if depth in opened:
                    start, first, d = opened.pop(depth)
                    want.remove((f, start, None, first, None, d))
                    want.add((f, start, at, first, line, d))
                depth -= 1
            elif c == "\n":
                depths.add((f, line, depth))
                line += 1
        depths.add((f, line, depth))
    assert set(map(tuple, block_spans(df).collect())) == want
    assert set(map(tuple, line_depths(df).collect())) == depths
