import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from custlattice.llm import chatformat
from custlattice.llm.chatformat import format_turn, parse_turn, prefix_trees, read_back

KIND = "conv_id bigint, turn bigint, role string, text string, node string, path int"


def turns_of(spark, conversations):
    rows = [(c, t, role, text, "x", 1) for c, turns in conversations for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, KIND)


def plain(turns):
    both, loss = hashlib.sha256(), ""
    for role, text in turns:
        both.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    formatted = "".join(format_turn(r or "", t or "")[0] for r, t in turns)
    return (len(turns), both.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))


PART = st.text(alphabet="<|\\>im_startend\n é", max_size=20)


@settings(max_examples=500, deadline=None)
@given(PART, PART)
def test_turns_come_back(role, text):
    formatted, a, b = format_turn(role, text)
    assert parse_turn(formatted) == (role, text) and chatformat.unescape(formatted[a:b]) == text
    assert formatted.count(chatformat.START) == 1 and formatted.count(chatformat.STOP) == 1


def sample():
    rng = random.Random(3)
    first = ("system", "be kind")
    out = [(i, [first, *[(rng.choice(["user", "assistant"]), f"t{rng.randrange(3)} <|im_end|>") for _ in range(rng.randrange(1, 6))]]) for i in range(60)]
    out += [(100, [("user", "a")]), (101, [("user", "a")]), (102, [("user", "a"), ("assistant", None), (None, "x"), ("assistant", "")])]
    out += [(103, [("user", f"{i}") for i in range(300)]), (104, [("assistant", "y" * 100_000)])]
    return out


def test_reads_back_every_conversation(spark):
    conversations = sample()
    rows = read_back(*prefix_trees(turns_of(spark, conversations))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == {c: plain(t) for c, t in conversations}


def test_trees_share_and_attend_to_ancestors(spark):
    conversations = sample()
    for partitions in ("1", "13"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            nodes = prefix_trees(turns_of(spark, conversations))[0].collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        prefixes = {tuple(t[:n]) for _, t in conversations for n in range(1, len(t) + 1)}
        # turns that format alike are one node
        assert len(nodes) == len({tuple((r or "", x or "") for r, x in p) for p in prefixes})
        by = {n.node: n for n in nodes}
        order = sorted(nodes, key=lambda n: n.begin)
        at = 0
        path = []
        for n in order:
            assert n.begin == at and n.end - n.begin == len(n.formatted)
            at = n.end
            del path[n.depth :]
            assert (path[-1] if path else None) == n.parent  # depth first
            above = [by[p] for p in path]
            path.append(n.node)
            assert n.position == sum(a.end - a.begin for a in above) and n.tree == path[0]
            units = sorted(u for a in above for u in (a.begin, a.end))
            joined = [u for u in units if units.count(u) == 1]
            assert n.attends == joined


def test_odd_tables(spark):
    turns = turns_of(spark, [])
    nodes, uses = prefix_trees(turns)
    assert nodes.count() == uses.count() == read_back(nodes, uses).count() == 0
    rows = [(None, None, None, None, "x", 1), (1, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1), (None, 1, "user", "b", "x", 1)]
    got = {r.conv_id: r.n_turns for r in read_back(*prefix_trees(spark.createDataFrame(rows, KIND))).collect()}
    assert got == {None: 2, 1: 2}
