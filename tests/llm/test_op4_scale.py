import sparkseries.llm.mixing as m


def test_scale_of_weights_does_not_matter():
    for scale in (1e-9, 1e-5, 1, 1e6):
        assert m.whole_weights({"a": 3 * scale, "b": scale}) == {"a": 3, "b": 1}
    assert m.whole_weights({f"{i}": 1.0 for i in range(1_000)}) == {f"{i}": 1 for i in range(1_000)}
    assert m.whole_weights({}) == {}
