from souklens.plans import cohort


def test_periods_beyond_the_columns_stay_in_the_sparse_row(spark, monkeypatch):
    def cells(last):
        return spark.createDataFrame([("2000-01", 0, 4, 4, 100.0), ("2000-01", last, 1, 4, 25.0), ("2000-02", 0, 3, 3, 100.0)],
                                     "cohort_ym string, period_number int, n_customers long, cohort_size long, retention_pct double")

    monkeypatch.setattr(cohort, "cohort_long", lambda L: cells(L))
    row = cohort.h2_cohort_pivot_all(119).orderBy("cohort_ym").collect()[0]
    assert (row["p0"], row["p118"], row["p119"], row["rates"]) == (100.0, 0.0, 25.0, "0:100.00,119:25.00")
    far = cohort.h2_cohort_pivot_all(150).orderBy("cohort_ym").collect()
    assert (far[0]["p0"], far[0]["p119"], far[0]["rates"]) == (100.0, 0.0, "0:100.00,150:25.00")
    assert far[1]["rates"] == "0:100.00"
    assert cohort.cohort_rows(150).where("cohort_ym = '2000-01'").first()["rates"] == {0: 100.0, 150: 25.0}
    assert cohort.h5_cohort_heatmap(150).columns == ["cohort_ym", "cohort_size", *[f"p{k}" for k in range(13)]]
