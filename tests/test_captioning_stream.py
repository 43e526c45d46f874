"""Captions as state of a stream: attempts are counted over runs, and nothing is asked for twice."""

from pagewright.streaming import captioning


class Failing:
    """Notes every call in a file of its own; fails for names as often as told."""

    def __init__(self, folder, failures):
        self.folder, self.failures = str(folder), failures

    def __call__(self, content, prompt):
        import os
        name = bytes(content).decode()
        with open(os.path.join(self.folder, f"{name}-{os.urandom(6).hex()}"), "w"):
            pass
        calls = sum(f.startswith(f"{name}-") for f in os.listdir(self.folder))
        if calls <= self.failures.get(name, 0):
            raise ValueError(f"no {name}")
        return f"{prompt} {name}"


def test_attempts_over_runs(spark, tmp_path):
    pictures, calls, out = tmp_path / "pictures", tmp_path / "calls", str(tmp_path / "captions")
    pictures.mkdir(), calls.mkdir()
    spark.createDataFrame([(n, "see") for n in ("a.png", "b.png", "c.png", "d.png")], "fname string, prompt string").write.parquet(
        str(tmp_path / "prompts"))
    prompts = spark.read.parquet(str(tmp_path / "prompts"))
    captioner = Failing(calls, {"b": 1, "c": 99})

    def run():
        query = captioning.start(captioning.picture_stream(spark, str(pictures)), prompts, captioner, out, attempts=3)
        assert query.awaitTermination(60)

    def called(name):
        return sum(p.name.startswith(f"{name}-") for p in calls.iterdir())

    for name in ("a", "b", "c", "unasked"):
        (pictures / f"{name}.png").write_bytes(name.encode())
    run()
    first = {r["fname"]: r for r in captioning.latest(captioning.outcomes(spark, out)).collect()}
    assert first["a.png"]["caption"] == "see a" and first["a.png"]["attempts"] == 1
    assert set(first) == {"a.png", "b.png", "c.png"}
    (pictures / "d.png").write_bytes(b"d")
    for _ in range(3):      # restarts from the checkpoint: what failed is due, with or without new pictures
        run()
    last = {r["fname"]: r for r in captioning.latest(captioning.outcomes(spark, out)).collect()}
    assert [(n, last[n]["attempts"], last[n]["caption"], last[n]["error"]) for n in sorted(last)] == [
        ("a.png", 1, "see a", None), ("b.png", 2, "see b", None), ("c.png", 3, None, "ValueError: no c"), ("d.png", 1, "see d", None)]
    assert [called(n) for n in ("a", "b", "c", "d", "unasked")] == [1, 2, 3, 1, 0]
    assert captioning.outcomes(spark, out).count() == 7
