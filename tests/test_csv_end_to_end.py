"""The reports that need orders and targets only, from invented CSV files
to results; and the quality reports on rows with NULLs and repeats."""

import datetime as dt
from collections import Counter
from decimal import Decimal as D

import pytest

from ledgerlens.plans import reports as R
from ledgerlens.sources import schemas
from ledgerlens.sources.staging import stage_csv_tables
from ledgerlens.sources.tables import from_frames

# (id, day, customer, state, city): four months, customers in several
PLACES = [("Northmark", "Tarn"), ("Eastmark", "Quill"), ("Westmark ", "Longhaven")]
ORDERS = [(f"X-{900 + i}", dt.date(2021, 1, 3) + dt.timedelta(days=5 * i), f"Person {i * 7 % 9}",
           *PLACES[i * i % 3]) for i in range(24)]
TARGETS = [(m, c, D(f"{100 + 7 * i + j}.50")) for i, m in enumerate(("Jan-21", "Feb-21", "Mar-21"))
           for j, c in enumerate(("Lamps", "Rugs"))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")

    def write(name, header, rows):
        path = folder / name
        path.write_bytes(("\r\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\r\n").encode())
        return str(path)

    orders = write("o.csv", schemas.ORDER_HEADER,
                   [(i, d.strftime("%d-%m-%Y"), c, s, p) for i, d, c, s, p in ORDERS])
    details = write("d.csv", schemas.DETAIL_HEADER, [("X-900", "1.00", "0.50", "1", "Lamps", "Desk", "Cash")])
    targets = write("t.csv", schemas.TARGET_HEADER, [(m, c, str(t)) for m, c, t in TARGETS])
    staged, rejects = stage_csv_tables(spark, orders, details, targets)
    assert all(r.count() == 0 for r in rejects.values())
    return staged


def rows(df):
    return [tuple(r) for r in df.collect()]


def first_month():
    first = {}
    for _, d, c, *_ in ORDERS:
        first[c] = min(first.get(c, d), d)
    return {c: d.replace(day=1) for c, d in first.items()}


def test_quality_reports(tables):
    assert rows(R.dq_nulls_orders(tables)) == [(0,) * 5]
    assert rows(R.dq_nulls_targets(tables)) == [(0,) * 3]
    assert rows(R.dq_duplicate_orders(tables)) == []
    days = [o[1] for o in ORDERS]
    assert rows(R.dq_date_range(tables)) == [(min(days), max(days), (max(days) - min(days)).days)]
    assert rows(R.dq_distinct_target_categories(tables)) == [("Lamps",), ("Rugs",)]


def test_customer_acquisition(tables):
    new = Counter(m.isoformat() for m in first_month().values())
    total, want = 0, []
    for m in sorted(new):
        total += new[m]
        want.append((m, new[m], total))
    assert rows(R.customer_acquisition(tables)) == want


def test_market_entry_timeline(tables):
    want = {}
    for i, d, c, s, p in ORDERS:
        if s not in want or (d, i) < want[s][:2]:
            want[s] = (d, i, c, p)
    assert sorted(rows(R.market_entry_timeline(tables))) == sorted(
        (s, i, d, c, p) for s, (d, i, c, p) in want.items())


def test_cohort_retention(tables):
    first, active = first_month(), {}
    for _, d, c, *_ in ORDERS:
        k = (d.year - first[c].year) * 12 + d.month - first[c].month
        active.setdefault((first[c].isoformat(), k), set()).add(c)
    size = Counter(m.isoformat() for m in first.values())
    got = [(r["cohort_month"], r["cohort_size"], r["month_index"], r["active_customers"])
           for r in R.cohort_retention(tables).collect()]
    assert got == [(m, size[m], k, len(c)) for (m, k), c in sorted(active.items())]


def test_weekday_histogram(tables):
    n = Counter(o[1].strftime("%A") for o in ORDERS)
    got = rows(R.weekday_histogram(tables))
    assert {(d, c) for d, c, _ in got} == set(n.items()) and all(b == "*" * c for _, c, b in got)
    assert all(b == "*" * (c // 3) for _, c, b in rows(R.weekday_histogram(tables, orders_per_mark=3)))


def test_bar_too_long_names_the_parameter(spark):
    from pyspark.sql import functions as F
    from ledgerlens.operators.histogram import text_bar
    df = spark.createDataFrame([(3_000_000_000,)], "n long")
    with pytest.raises(Exception, match="orders_per_mark"):
        df.select(F.length(text_bar(F.col("n"), "*", 1, "orders_per_mark"))).collect()
    assert df.select(F.length(text_bar(F.col("n"), "*", 1_000_000))).first()[0] == 3000


@pytest.fixture(scope="module")
def dirty(spark):
    """NULLs, a repeated order, a hot and a NULL line key."""
    orders = [("A", dt.date(2020, 1, 1), "P", "S", "T"), ("A", dt.date(2020, 2, 1), "Q", "S", None),
              ("B", None, None, None, "T"), (None, dt.date(2020, 1, 5), "P", None, None)]
    line = (D("5.00"), D("1.00"), 1, "c", "s", "m")
    details = [("A", *line)] * 40 + [("Z", *line)] * 30 + [(None, *line)] * 7 + [
        ("B", None, None, None, None, None, None)]
    targets = [("Jan-20", None, D("1.00")), (None, "c", None)]
    return from_frames(spark.createDataFrame(orders, schemas.ORDER_LIST),
                       spark.createDataFrame(details, schemas.ORDER_DETAILS),
                       spark.createDataFrame(targets, schemas.SALES_TARGET))


def test_quality_reports_count_what_is_wrong(dirty):
    assert rows(R.dq_nulls_orders(dirty)) == [(1, 1, 1, 2, 2)]
    assert rows(R.dq_nulls_details(dirty)) == [(7, 1, 1, 1, 1, 1)]
    assert rows(R.dq_nulls_targets(dirty)) == [(1, 1, 1)]
    assert rows(R.dq_duplicate_orders(dirty)) == [("A", 2)]
    assert rows(R.dq_orphan_details(dirty)) == [(37,)]


def test_repeated_order_ids_count_once_per_group(dirty):
    s = R.business_summary(dirty).first()
    assert (s["total_orders"], s["unique_customers"], s["states_covered"], s["cities_covered"]) == (2, 2, 1, 1)
    months = {r["order_month"]: r["total_orders"] for r in R.monthly_trend(dirty).collect()}
    assert months == {None: 1, "2020-01-01": 1, "2020-02-01": 1}
    states = {r["state"]: (r["total_orders"], r["unique_customers"]) for r in R.state_performance(dirty).collect()}
    assert states == {"S": (1, 2), None: (1, 0)}


@pytest.mark.parametrize("values", [[0, 0], [-2, -8], [5, -5], [80, 20], [10, 0, -5], [-1, -99]])
def test_pareto_of_any_total(spark, values):
    """A row is a top driver if its running share of the signed total is at
    most 80 percent; there is no share of a zero total."""
    from ledgerlens.operators.windows import pareto
    from ledgerlens.plans import labels as L
    df = spark.createDataFrame([(str(i), D(v)) for i, v in enumerate(values)], "k string, v decimal(20,2)")
    got = {r["k"]: r["pareto_group"] for r in pareto(df, "v", ["k"]).collect()}
    total, run, want = sum(values), 0, {}
    for v, k in sorted(((v, str(i)) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1])):
        run += v
        want[k] = L.PARETO_TOP if total and run * 100 / total <= 80 else L.PARETO_REST
    assert got == want


def test_rfm_reference_date(dirty):
    assert [r["r_score"] for r in R.rfm_segments(dirty, as_of="2030-01-01").collect()] == [
        r["r_score"] for r in R.rfm_segments(dirty).collect()]
    assert R.rfm_segment_summary(dirty, as_of="2030-01-01").count() > 0
