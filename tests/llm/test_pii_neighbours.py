"""Addresses before a full stop."""

from test_pii import run


def test_mail_at_the_end_of_a_sentence(spark):
    texts = [
        "Write to user@example.com.", "user@example.com. Next", "user@example.com, next", "user@mail.example.com.5 more",
        "user@example.com...", "user@1.2.example.com", "user@host.5", "user@host.",
    ]
    got = run(spark, texts)
    assert [r[4] for r in got] == [1, 1, 1, 1, 1, 1, 0, 0]
    local = {r[3].replace("Write to ", "").split("@")[0] for r in got[:6]}
    assert len(local) == 1 and local != {"user"}
    assert [r[3].split("@")[1] for r in got] == [t.split("@")[1] for t in texts]
    assert [r[3] for r in run(spark, [r[3] for r in got], back=True)] == texts
