"""Which of many expressions may hit a file, found in one pass over its bytes: an automaton of all the texts that their hits hold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.content import bound_batches
from quarrymill.plans.analysis import factors

#: From so many expressions on, the automaton is faster than looking for the text of each; both find the same hits.
MANY = 24


def candidates(content: Column, regexes: list[str]) -> Column:
    """Ordinals of the expressions that may hit each content, ascending: those of which it holds a text, ignoring case, and those of which nothing can be said."""
    texts: dict[str, list[int]] = {}
    always = []
    for i, regex in enumerate(regexes):
        own = factors(regex)
        if not own or min(map(len, own)) < 2:
            always.append(i)
        for t in own if own and min(map(len, own)) >= 2 else ():
            texts.setdefault(t, []).append(i)
    of = list(texts.values())
    bound_batches()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, t in enumerate(texts):
            automaton.add_word(t, k)
        automaton.make_automaton()
        for b in batches:
            found = []
            for x in b:
                met = {k for _, k in automaton.iter(bytes(x).lower().decode("latin-1"))} if x is not None and texts else ()
                found.append(sorted({i for k in met for i in of[k]}.union(always)) if x is not None else [])
            yield pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<int>")(content)
