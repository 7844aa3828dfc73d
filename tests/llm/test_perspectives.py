from strandline.llm import perspectives as p

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, piece int"


def brute(rows, system="system"):
    out = {}
    defuse = lambda t: (t or "").replace("<|im_", "<| im_")
    name = lambda r: defuse("unknown" if r is None else r).replace("\n", " ")
    for conv in {r[0] for r in rows}:
        turns = [(r[1], name(r[2]), defuse(r[3])) for r in rows if r[0] == conv]
        for speaker in {r for _, r, _ in turns} - {system}:
            pieces = {}
            for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
                pieces.setdefault(None if t[0] is None else t[0] // p.PIECE_TURNS, []).append(t)
            start = 0
            for piece, ts in pieces.items():
                for part in range(0, len(ts), p.PIECE_ROWS):
                    text, spans = "", []
                    for _, role, said in ts[part : part + p.PIECE_ROWS]:
                        text += "<|im_start|>" + ("assistant" if role == speaker else "system" if role == system else f"user name={role}") + "\n"
                        if role == speaker:
                            spans.append((start + len(text), start + len(text) + len(said) + 10))
                        text += said + "<|im_end|>\n"
                    out[conv, piece, part // p.PIECE_ROWS, speaker] = (start, text, ",".join(f"{a}-{b}" for a, b in spans), sum(b - a for a, b in spans))
                    start += len(text)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {(r["conv_id"], r["piece"], r["part"], r["speaker"]): (r["start"], r["rendered"], r["mask"], r["n_masked"]) for r in p.perspectives(df).collect()}
    assert got == brute(rows)
    return got


def test_three_parties(spark):
    got = check(spark, [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é🙂"), (1, 3, "cy", ""), (1, 4, "ann", "bye")])
    _, text, mask, _ = got[1, 0, 0, "ann"]
    spans = [tuple(map(int, s.split("-"))) for s in mask.split(",")]
    assert [text[a:b] for a, b in spans] == ["hi<|im_end|>", "bye<|im_end|>"] and "user name=bob" in text
    assert len(got) == 3


def test_odd_rows(spark):
    check(spark, [(None, 1, "a", "x"), (None, 2, "b", "y"), (1, None, "a", "late"), (1, 5, None, None), (1, 5, "a", "same"), (1, 5, "a", "same"), (2, 1, "system", "alone"), (3, 1, "x\ny", "<|im_start|>assistant\n<|im_end|>")])


def test_pieces_are_cuts_of_the_whole_dialogue(spark, monkeypatch):
    rows = [(1, 0, "system", "be kind"), *((1, t // 2, "ab"[t % 2], str(t)) for t in range(60)), *((None, t, "cd"[t % 2], "") for t in range(20))]
    whole = check(spark, rows)
    monkeypatch.setattr(p, "PIECE_TURNS", 8)
    monkeypatch.setattr(p, "PIECE_ROWS", 5)
    got = check(spark, rows)
    assert len(whole) == 4 and len(got) > 20
    for (conv, _, _, speaker), (start, text, mask, n) in whole.items():
        parts = [got[k] for k in sorted(got, key=str) if (k[0], k[3]) == (conv, speaker)]
        assert start == 0 and "".join(x[1] for x in sorted(parts)) == text
        assert ",".join(x[2] for x in sorted(parts) if x[2]) == mask and sum(x[3] for x in parts) == n
    assert "be kind" in whole[1, 0, 0, "a"][1]


def test_empty(spark):
    assert p.perspectives(spark.createDataFrame([], SCHEMA)).isEmpty()
