import datetime

from pagelode.streaming import revisits


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def test_sites_fall_due_once_and_again_after_a_visit(spark, tmp_path):
    folder, checkpoint, crawled = str(tmp_path / "visits"), str(tmp_path / "mark"), []
    hours = {"http://a/": 24, "http://b/": 6}
    rows = lambda sites: spark.createDataFrame([(s, hours[s]) for s in sites], "site_url string, frequency_hours int")

    def until(hour, visiting=True):
        """Time goes on to an hour; what falls due is crawled. A new query each time, from the same checkpoint."""
        revisits.tell_time(spark, folder, at(hour))
        found = []
        revisits.recrawl(spark, folder, checkpoint, lambda sites, n: found.extend((r["site_url"], r["due_at"]) for r in sites.collect())).awaitTermination()
        crawled.extend(found)
        if found and visiting:
            revisits.tell_visits(rows([s for s, _ in found]).coalesce(1), folder, at(hour))
        return sorted(found)

    setting = spark.conf.get(revisits._PROVIDER, None)
    revisits.tell_visits(rows(hours).coalesce(1), folder, at(0))
    assert until(5) == []
    assert until(7) == [("http://b/", at(6))]
    assert until(7.5) == []  # nothing falls due twice
    assert until(14) == [("http://b/", at(13))]
    assert until(25, visiting=False) == [("http://a/", at(24)), ("http://b/", at(20))]
    assert until(60) == []  # not visited since: due already
    assert len(crawled) == len(set(crawled)) == 4
    assert spark.conf.get(revisits._PROVIDER, None) == setting
