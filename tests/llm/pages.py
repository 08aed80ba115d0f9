"""Small recognised pages for tests."""

SCHEMA = "project string, pos int, language string, blocks array<struct<type:string,spans:array<struct<text:string>>>>, words array<struct<t:string,b:int>>, key string"


def page(project, pos, *lines, language="uzb", blocks=None):
    words = [(t, 100 + 10 * i) for i, line in enumerate(lines) for t in line.split()]
    made = [("PARAGRAPH", [(t,)]) for t in (blocks if blocks is not None else lines)]
    return (project, pos, language, made, words, "clash")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


PROSE = (
    "Katta daryoda kichik baliqlar yurdi va kechqurun uyga qaytib", "keldi. Bolalar bilan otalari sokin bogʻda uzoq vaqt suhbat", "qildi, keyin hammasi dasturxon atrofida oʻtirdi.",
)
