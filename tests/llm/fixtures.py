"""A small, awkward corpus: nulls, empties, long texts, copies, ties, clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + str(r.randrange(40)) if r.random() < 0.5 else r.choice(WORDS))
        if r.random() < 0.08:
            out[-1] += ".\n" + r.choice(WORDS).title()
    return " ".join(out)


def texts() -> list:
    base = [prose(i, 30 + 17 * i) for i in range(12)]
    near = [base[5].replace("alpha", "alpho", 1), base[5] + " omega", base[6].replace("\n", "\n\n")]
    odd = [None, "", " ", "\n\n \t\n", "one", "two words", "x" * 5000, "1 " * 3000, "é ü ß 漢字 😀 a b c", "\x1c\x1d a\x85b　",
           "it's <|endoftext|> I'LL  see\r\n\ttabs   ", "9" * 4000, base[0] + "\n" + base[0], prose(99, 6000)]
    return base + near + [base[3]] * 4 + odd


def documents(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    rows += [(None, "null id text with words", None, None, None), (7, texts()[7], "en", "s1", 1), (7, texts()[7], "en", "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return documents(spark).limit(0)


def clashing(spark):
    """The corpus with extra columns under names that operators use inside."""
    df = documents(spark)
    for name in ("_key", "_rank", "_toxic", "_t", "_drop", "_h", "_terms", "words", "code", "h1", "line", "ids", "Salt"):
        df = df.selectExpr("*", f"1 AS `{name}`")
    return df
