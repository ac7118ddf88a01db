import random

import pytest

from joblume.operators import tickets
from joblume.sinks.tickets import new_tickets

SCHEMA = "pos long, titulo string, empresa string, origem string, localizacao string, link_inscricao string"


def loop(items, known=()):
    titles, out = {k.lower().strip() for k in known if k}, []
    for pos, titulo, empresa, origem, *_ in sorted(items):
        search = f"{titulo} @ {empresa}".lower().strip()
        if any(search in title for title in titles):
            continue
        titles.add(f"[{origem}] {titulo} @ {empresa}".lower().strip())
        out.append(pos)
    return out


def random_items(rng, n, alphabet, origins):
    def word():
        while True:
            text = "".join(rng.choices(alphabet, k=rng.randint(1, 5)))
            if text.strip():
                return text
    return [(i, word(), word(), rng.choice(origins), "", "") for i in range(n)]


# lefts broadcast, or shuffled as if they were too many
LIMITS = [10**6, 0, 0]
CASES = [
    (["a", "b", "A", " "], ["", "o", "web"]),
    (["a", "b", "]", "[", " ", "[o] ", "o] "], ["o", "p", "q]", "[o"]),
    (["a", " @ ", "@", " ", "b", " @ @ "], ["o", "x @ a", " @ ", "@"]),
    (["a", "[o] ", "[o] a @ b", "] a", " @ ", "o] "], ["o", "o] a @ b", "[o", "o @ a"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeats_match_a_loop(spark, case, seed):
    rng = random.Random(seed)
    items = random_items(rng, 150, *CASES[case])
    got = tickets.drop_repeats(spark.createDataFrame(items, SCHEMA), ["pos"], LIMITS[seed])
    assert sorted(r.pos for r in got.collect()) == loop(items)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_history_and_repeats_match_a_loop(spark, case):
    rng = random.Random(9)
    items = random_items(rng, 150, *CASES[case])
    known = [f"[x] {t}{rng.choice(['', 'b'])} @ {rng.choice(['', ' '])}{e} " for _, t, e, *_ in random_items(rng, 40, *CASES[case])]
    known += [None, "", "no anchor", " @ ", "@"]
    history = spark.createDataFrame([(k,) for k in known], "title string")
    frame = spark.createDataFrame(items, SCHEMA)
    accepted = loop(items, known)
    rest = [{r.pos for r in tickets.drop_known(frame, history, limit).collect()} for limit in (0, 10**6)]
    assert rest[0] == rest[1] >= set(accepted)
    out = new_tickets(frame, history, ["pos"])
    expected = sorted(f"[{i[3]}] {i[1]} @ {i[2]}" for i in items if i[0] in set(accepted))
    assert sorted(r.title for r in out.collect()) == expected


def test_acceptance_decides_about_origins(spark):
    items = [(1, "xa", "b", "p"), (2, "a", "b", "o"), (3, "[o] a", "b", "q")]
    frame = spark.createDataFrame([(*i, "", "") for i in items], SCHEMA)
    assert sorted(r.pos for r in tickets.drop_repeats(frame, ["pos"]).collect()) == [1, 3]


def test_a_chain_is_settled_in_rounds(spark):
    items = [(0, "a", "b", "o")]
    for depth in range(1, 6):
        items.append((depth, "[o] " * depth + "a", "b", "o"))
    frame = spark.createDataFrame([(*i, "", "") for i in items], SCHEMA)
    assert sorted(r.pos for r in tickets.drop_repeats(frame, ["pos"]).collect()) == loop([(*i, "", "") for i in items])


def test_containment_has_no_theta_join(spark):
    items = spark.createDataFrame(random_items(random.Random(1), 20, *CASES[0]), SCHEMA)
    for limit in (0, 10**6):
        plan = tickets.drop_repeats(items, ["pos"], limit)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fields(spark):
    frame = spark.createDataFrame([(1, " Dev", "Acme ", "Web", "SP", "http://x")], SCHEMA)
    row = tickets.with_ticket_fields(frame).first()
    assert (row.title, row.search, row.body) == ("[Web]  Dev @ Acme ", "dev @ acme", "Empresa: Acme \nLocal: SP\nLink: http://x")
