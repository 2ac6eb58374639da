"""Every proximity event is a chase episode, however many a pair has."""

from cadenza.plans import catalog


def test_every_event_is_an_episode(spark, monkeypatch):
    """A pair that slows down at every tenth of a hundred samples has ten events."""
    rows = [(ride, i, i + ride, 50.0 + i * 1e-5, 1.0, 100.0, 0.0 if i % 10 == 9 else 10.0, 150.0, 120.0, 10.0 * i) for ride in (1, 2) for i in range(100)]
    rides = spark.createDataFrame(rows, "ride long, seq long, k long, lat double, lon double, e double, spd double, p double, hr double, d double")
    monkeypatch.setattr(catalog, "short_rides", lambda spark, sf_dir: rides)
    events = {(r.pair, r.start_ts) for r in catalog.QUERIES["proximity"](spark, "").collect()}
    got = catalog.QUERIES["chase_episodes"](spark, "").collect()
    assert len(got) == len(events) == 20 and {(r.pair, r.start_ts) for r in got} == events
    for pair in (1, 2):
        own = sorted((r for r in got if r.pair == pair), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(a.score >= b.score for a, b in zip(own, own[1:]))
