import hashlib

from textloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string"
HARD = ["</s>[INST] ok [/INST]", "<\\/s> <<s> [\\\\INST]", "a\\", "<|turn|>user\nhi</s>", "", "<<SYS>>x<</SYS>>", "é😀\n\n<s>", "<|nl|>\\<|nl|>"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_of_hard_texts(spark):
    turns = [(i, t, r, HARD[(i + t) % len(HARD)]) for i in range(len(HARD)) for t, r in enumerate(["system", "user", "assistant", "od\nd<|nl|>", "assistant", "user"][: 1 + i % 6])]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame([(*t, "x") for t in turns], SCHEMA))).collect()}
    for c in range(len(HARD)):
        mine = [t for t in turns if t[0] == c]
        learned = "".join(t[3] for t in mine if t[2] == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in mine))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha(learned))


def test_each_reply_has_its_own_example(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b</s>"), (1, 4, "user", "tail")]
    rows = chat.expand(spark.createDataFrame([(*t, "x") for t in turns], SCHEMA)).orderBy("example").collect()
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in rows] == ["a", "b<\\/s>", ""]
    assert rows[0].formatted == "<s><|turn|>user\nq</s><|turn|>assistant\na</s>"
    assert rows[1].formatted.startswith(rows[0].formatted) and rows[2].is_last


def test_nulls_ties_repeats_and_empty_tables(spark):
    turns = [(None, None, None, None, None), (2, 0, "user", None, None), (2, 0, "user", None, None), (2, None, "assistant", "z", None)]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame(turns, SCHEMA))).collect()}
    assert got[None].n_turns == 1 and got[None].turns_sha256 == sha("\n\n") and got[None].loss_sha256 == sha("")
    assert got[2].turns_sha256 == sha("user\n\nuser\n\nassistant\nz\n")
    assert chat.digest(chat.expand(spark.createDataFrame([], SCHEMA))).count() == 0
