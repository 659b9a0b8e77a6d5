from repostrata.sources.history import COMMIT_MARK
from repostrata.streaming import daily


def test_daily_counts_keep_the_maximum(spark, tmp_path):
    logs, target, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs.mkdir()

    def commit(i):
        return f"{COMMIT_MARK}\n{'a' * 39}{i}\nAnn\na@x.org\n2024-01-0{1 + i % 2}T10:00:00+00:00\n\n1\t1\tx.py\n"

    for name, n in (("r1", 3), ("r2", 1)):
        (logs / f"{name}.log").write_text("".join(commit(i) for i in range(n)))
    for _ in range(2):
        daily.append_daily(daily.log_stream(spark, str(logs)), target, check).awaitTermination(120)
    got = {(r["repo_id"], str(r["commit_date"])): r["commit_count"] for r in daily.current_daily(spark, target).collect()}
    assert got == {("r1", "2024-01-01"): 2, ("r1", "2024-01-02"): 1, ("r2", "2024-01-01"): 1}
