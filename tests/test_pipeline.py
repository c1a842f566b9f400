"""From images to vectors, and the command line."""

import json

from motleydex.__main__ import main
from motleydex.operators.embed_job import HashEmbedder
from motleydex.operators.label_store import label_folder, pipeline, reload, save_labels
from motleydex.operators.labels import StubLabeler, label_images
from motleydex.sources import files


def folder(tmp_path, n=3):
    d = tmp_path / "images"
    d.mkdir()
    for i in range(n):
        (d / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    return str(d)


def test_pipeline_is_resumable(spark, tmp_path):
    root, images = str(tmp_path / "db"), folder(tmp_path)
    assert pipeline(spark, root, images, StubLabeler(), HashEmbedder()) == {"label": {"total": 3, "succeeded": 3, "failed": 0}, "embed": {"embedded": 3}}
    t = reload(spark, root)
    assert t["items"].count() == 3 and t["vectors"].count() == 12 and t["search_texts"].count() == 3
    rejected = save_labels(spark, root, label_images(files.image_files(spark, images), StubLabeler()))
    assert rejected.count() == 3 and reload(spark, root)["items"].count() == 3
    assert pipeline(spark, root, images, StubLabeler(), HashEmbedder())["embed"] == {"embedded": 0}
    assert reload(spark, root)["vectors"].count() == 12 and reload(spark, root)["search_texts"].count() == 3


def test_limit(spark, tmp_path):
    assert label_folder(spark, str(tmp_path / "db"), folder(tmp_path), StubLabeler(), 2)["total"] == 2


def test_file_content(spark, tmp_path):
    d = folder(tmp_path)
    assert files.file_content(spark, d, "/memes/1.jpg") == b"xx" and files.file_content(spark, d, "9.jpg") is None


def test_command_line(spark, data, tmp_path, capsys):
    out, kept = str(tmp_path / "l.json"), str(tmp_path / "k.json")
    main(["export", data, out], spark)
    main(["filter", out, kept, "language", "hindi"], spark)
    assert all(x["primary_language"] == "hindi" for x in json.load(open(kept)))
    main(["build", kept], spark)
    main(["query", kept, "exam", "result"], spark)
    main(["stats", data], spark)
    main(["search", data, "exam result", "--limit", "3"], spark)
    assert '"total_results"' in capsys.readouterr().out
