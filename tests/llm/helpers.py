"""Rows with odd cases, and plain implementations to compare with."""

from collections import defaultdict

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "word", "one two three four", "same text here for a copy of it", "same text here for a copy of it", "x" * 5000, "a\n\nb \t c\n", "\x1c\x85 odd \xa0white", "<|endoftext|> in text <|endoftext|>", "long " * 4000, "日本語 and ümläut, 12'345 %%% don't"]


def odd_docs(spark, more=()):
    """Odd texts with ids, a repeated row, nulls in other columns and a column whose name clashes with a result's."""
    rows = [(i, t, None, "src" if i % 2 else None, i) for i, t in enumerate([*ODD, *more])]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")


def empty(df):
    """No rows of the same columns."""
    return df.filter("1 = 0")


def components(texts: dict, width=5, percent=85) -> dict:
    """Connected components over every pair, by exact sets of words."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words)} if 0 < len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in having[s]:
                common[j] += 1
            having[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (find(i), len(sets[i])) for i in sets}
