"""A command that is cut off between any two publications can be run again without loss."""

import pytest

from notegrove import cli
from notegrove.operators import store


def test_harvest_cut_off_anywhere(spark, tmp_path, monkeypatch):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.md").write_text("# One\n\n" + "alpha beta. " * 120 + "\n## Two\n\n" + "gamma. " * 80)
    keys = {"sources": "source_id", "chapters": "chapter_id", "chunks": "chunk_id"}
    real, held = store.publish, {}
    for stop in (3, 0, 1, 2):  # the first run is whole
        root = f"file://{tmp_path}/store{stop}"
        made = []

        def publish(df, at, name, stop=stop, made=made):
            if len(made) == stop:
                raise RuntimeError("lost")
            made.append(name)
            return real(df, at, name)

        with monkeypatch.context() as m:
            m.setattr(store, "publish", publish)
            if stop == 3:
                cli.harvest(spark, root, str(box))
            else:
                with pytest.raises(RuntimeError):
                    cli.harvest(spark, root, str(box))
        if stop < 3:
            assert cli.harvest(spark, root, str(box))["sources"] == 1
        got = {n: sorted(r[0] for r in cli.read(spark, root, n).select(k).collect()) for n, k in keys.items()}
        held = held or got
        assert got == held and all(held.values()), stop
