from twinfold.llm import preferences as sut

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"


def conversation(i, *turns):
    return [(i, k, r, t, "x") for k, (r, t) in enumerate(turns)]


S, U, A = "system", "user", "assistant"


def corpus():
    long = "word " * 20_000
    return [
        *conversation(0, (S, "be kind"), (U, "hé?"), (A, "yes"), (U, "more"), (A, "fine")),
        *conversation(1, (S, "be kind"), (U, "hé?"), (A, "no")),
        *conversation(2, (U, "a"), (A, "b")),
        *conversation(3, (U, "a"), (A, "b")),
        *conversation(4, (U, "a")),
        *conversation(5, (U, "a"), (A, long), (U, ""), (A, None)),
        *conversation(6, (U, None), (None, "x")),
        *conversation(7, (U, ""), (None, "x")),
        *conversation(8, (U, "alone")),
        (None, 0, U, "no id", "x"),
        *conversation(10, (U, "q"), (A, "r")),
        *conversation(10, (U, "q"), (A, "r")),
        *conversation(11, (U, "q"), (A, "r")),
        (11, None, A, "first", "x"),
    ]


def brute(rows):
    convs = {}
    for i, k, r, t, _ in rows:
        if i is not None:
            convs.setdefault(i, []).append((k is not None, k or 0, r is not None, r or "", t is not None, t or "", r, t))
    render = lambda ts: "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in ts)

    def mask(ts):
        at, out = 0, []
        for r, t in ts:
            a = at + len(f"<|{r or ''}|>\n")
            at = a + len(f"{t or ''}<|end|>\n")
            if r == A:
                out.append(f"{a}-{at}")
        return ",".join(out)

    want = []
    for c in sorted(convs):
        if c % 2 == 0 and c + 1 in convs:
            x, y = ([t[-2:] for t in sorted(convs[k])] for k in (c, c + 1))
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            want.append((c // 2, c, c + 1, n, render(x[:n]), render(x[n:]), render(y[n:]), mask(x[n:]), mask(y[n:])))
    return want


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = sut.format_preferences(sut.neighbouring_pairs(df))
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows)
    for r in out.collect():
        for side, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for span in filter(None, mask.split(",")):
                a, b = map(int, span.split("-"))
                assert side[:a].endswith("<|assistant|>\n") and side[a:b].endswith("<|end|>\n")


def test_empty(spark):
    assert sut.format_preferences(sut.neighbouring_pairs(spark.createDataFrame([], SCHEMA))).count() == 0
