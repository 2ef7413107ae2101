import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm.chat_format import _windows, digests, escape, format_windows, read_back, unescape, written
from graphloom.llm.cost_packing import TextTokenizer
from graphloom.llm.queries import CONTROL_TURNS, TOKENIZER


def words(text):
    return len(text.split())

TEXT = st.text(alphabet=st.sampled_from(list("ab\\<>/turn \n")) | st.characters(exclude_categories=["Cs"]), max_size=40)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    text = "".join(f"<turn {escape(r, True)}>\n{escape(t)}</turn>\n" for r, t in turns)
    assert read_back(text) == turns
    assert all(unescape(escape(t)) == t for _, t in turns)


def test_windows_keep_system_repeat_history_and_mask_it():
    turns = [("system", "be kind")] + [(("user", "assistant")[i % 2], f"w{i} " * 20) for i in range(20)]
    out = list(_windows(iter(turns), 100, 2, words))
    assert len(out) > 3
    new, trained = [], []
    for text, first, n_system, n_repeated, loss, size in out:
        back = read_back(text)
        assert size <= 100 and first == len(new)
        if first:
            assert n_system == 1 and back[0] == turns[0]
            assert back[1 : 1 + n_repeated] == turns[first - n_repeated : first]
        new += back[n_system + n_repeated :]
        trained += [unescape(text[s["start"] : s["end"]]) for s in loss]
    assert new == turns and trained == [t for r, t in turns if r == "assistant"]


def test_a_turn_above_the_budget_stays_whole():
    turns = [("user", "a " * 500), ("assistant", "b"), ("assistant", "c " * 300)]
    out = list(_windows(iter(turns), 64, 2, words))
    assert [t for w in out for t in read_back(w[0])[w[2] + w[3] :]] == turns


@pytest.mark.parametrize("sizes", [[300], [200, 200], [600], [600, 5]])
def test_long_system_turns_head_every_window(sizes):
    system = [("system", "s " * n) for n in sizes]
    turns = system + [(("user", "assistant")[i % 2], f"w{i} " * 100) for i in range(12)]
    out = list(_windows(iter(turns), 512, 2, words))
    new = []
    for text, first, n_system, n_repeated, _, size in out:
        back, heads = read_back(text), system[:first]
        assert back[: len(heads)] == heads and n_system == len(heads)
        new += back[n_system + n_repeated :]
        # above the budget only with a single new turn
        assert size <= 512 or len(back) == n_system + n_repeated + 1
    assert new == turns and len(out) > 3


def plain_windows(turns, sizes, budget, history):
    """(first turn, turns before the next window, system turns, repeated turns) by prefix sums over the whole list."""
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    heads = next((i for i, (role, _) in enumerate(turns) if role != "system"), len(turns))
    out, a, before = [], 0, 0
    while a < len(turns):
        system = sums[min(heads, a)]
        b = max([a + 1, *(k for k in range(a + 1, len(turns) + 1) if system + sums[k] - sums[a] <= budget)])
        repeats = [r for r in range(min(history, a - before) + 1) if system + sums[b] - sums[a - r] <= budget]
        out.append((a, b, min(heads, a), max(repeats, default=0)))
        before, a = a, b
    return out


def test_windows_equal_plain_prefix_sums_of_real_tokens():
    random.seed(10)
    tokenizer = TextTokenizer(TOKENIZER)
    count = lambda text: len(tokenizer.ids(text))
    over = 0
    for _ in range(60):
        turns = [("system", "Mind </turn>. " * random.randint(1, 40)) for _ in range(random.randint(0, 3))]
        turns += [(random.choice(["user", "assistant"]), random.choice(["a word ", "x\\", "日本 "]) * random.randint(0, 150)) for _ in range(random.randint(1, 25))]
        sizes = [count("".join(written(*t))) for t in turns]
        out = list(_windows(iter(turns), 512, 2, count))
        plain = plain_windows(turns, sizes, 512, 2)
        assert [(first, n_system, n_repeated) for _, first, n_system, n_repeated, _, _ in out] == [(a, s, r) for a, _, s, r in plain]
        for (text, _, n_system, n_repeated, _, size), (a, b, _, _) in zip(out, plain):
            assert size == count(text)
            assert read_back(text) == turns[:n_system] + turns[a - n_repeated : b]
            # above the budget only where one new turn and the system turns are
            assert size <= 512 or (b == a + 1 and n_repeated == 0 and sum(sizes[:n_system]) + sizes[a] > 512)
            over += size > 512
    assert over


def test_digests_equal_brute_force(spark):
    random.seed(9)
    roles = ["user", "assistant", "system", None, "as>si\nstant", "assistant"]
    bits = ["</turn>", "<turn user>", "\\", "é", " word", "\n", "日本"]
    rows = [*CONTROL_TURNS]
    for conv in [*range(30), None]:
        for turn in range(random.randint(1, 12)):
            text = "".join(random.choice(bits) for _ in range(random.randint(0, 60)))
            rows.append((conv, random.choice([turn, turn, None]), random.choice(roles), random.choice([text, text, None])))
    rows += [(40, i, "user" if i % 2 else "assistant", "long " * 30) for i in range(2000)] + [(41, 0, "assistant", "x" * 200_000)] + [(42, 0, "user", "same")] * 3
    random.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_turns")
    out = {r["conv_id"]: r for r in digests(format_windows(turns, TOKENIZER)).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, (x or "").encode())
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(out) == set(groups)
    for conv, own in groups.items():
        own.sort(key=lambda r: (low(r[1]), text(r[2]), text(r[3])))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        got = out[conv]
        assert (got["n_turns"], got["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digests(format_windows(turns.limit(0), TOKENIZER)).count() == 0


def test_reading_rejects_other_text():
    with pytest.raises(ValueError):
        read_back("x<turn user>\na</turn>\n")
