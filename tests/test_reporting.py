from gustline.operators import reporting as RP


def test_pipeline_listing_and_status(spark):
    runs = spark.createDataFrame(
        [("1", "Windmill-Pipeline", "RUNNING"), ("2", "windmill_gen", "IDLE"),
         ("3", "other", "RUNNING"), ("4", "WINDMILL x", None)],
        "id string, name string, state string")
    listed = RP.list_pipelines(runs).collect()
    assert sorted(r.id for r in listed) == ["1", "2", "4"]
    assert [r.state for r in listed if r.id == "4"] == ["UNKNOWN"]
    st = RP.pipeline_status(runs).first()
    assert (st.total_pipelines_jobs, st.active, st.idle) == (3, 1, 2)
