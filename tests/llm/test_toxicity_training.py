"""The CRF is trained for all its epochs."""

from tessera.llm import toxicity


def test_epochs(monkeypatch):
    made = []
    real = toxicity.marginals

    def counted(*args):
        made.append(1)
        return real(*args)

    monkeypatch.setattr(toxicity, "marginals", counted)
    monkeypatch.setattr(toxicity.ToxicityModel, "tag", lambda self, texts: [[0.0] for _ in texts])
    monkeypatch.setattr(toxicity.ToxicityModel, "_fit_score", lambda self, facts, toxic: None)
    monkeypatch.setattr(toxicity.ToxicityModel, "facts", lambda self, own: [0.0])
    toxicity.ToxicityModel().fit(["bad word", "good day"], [[1, 0], [0, 0]], [1, 0])
    assert len(made) == 40
