from veilspark.conf import EngineConf, read_yaml, write_state


def test_files_state_and_environment(tmp_path):
    base, local, state, bad = (str(tmp_path / n) for n in ("base.yaml", "local.yaml", "sub/state.yaml", "bad.yaml"))
    (tmp_path / "base.yaml").write_text("chunk_size: 900\nmin_agreement: 2\nunknown: {a: 1}\n")
    (tmp_path / "local.yaml").write_text("min_agreement: 3\nlatest_report: old\n")
    (tmp_path / "bad.yaml").write_text("- a\n- [")
    write_state(state, "r7", "2026-01-02")
    write_state(state, "r8", "2026-01-03")
    conf = EngineConf.read(base, local, bad, str(tmp_path / "none.yaml"), state=state, env={"VEILSPARK_CHUNK_SIZE": "700"})
    assert (conf.chunk_size, conf.min_agreement, conf.latest_report, conf.updated_at) == (700, 3, "r8", "2026-01-03")
    assert read_yaml(bad) == {} and EngineConf.read(env={}) == EngineConf()
