"""The written examples are whole texts, and losses come from them."""
from tidewheel.llm import chat, shared


def test_written_examples_hold_their_context(spark, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", f"said {t} <s>") for t in range(40)] + [(None, 0, "user", "a"), (None, 1, "assistant", "b")]
    written, real = {}, shared.materialise

    def seen(df, name):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(shared, "materialise", seen)
    got = {r.conv_id: r for r in chat.format_and_read(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    segments = {(r.conv_id, r.position): r.segment for r in written["chat-turns"].collect()}
    examples = written["chat-examples"].collect()
    assert len(examples) == 21
    for e in examples:
        assert e.text == "".join(segments[e.conv_id, k] for k in range(1, e.position + 1))
        assert e.text[e.loss_end :] == chat.TAIL
    assert (got[1].n_examples, got[None].n_examples, got[None].loss_chars) == (20, 1, 1)
