"""Table uses on sources with look-alikes, and the Bloom filter."""

from pyspark.sql import functions as F

from weftgraph.functions.bloom import bloom_filter
from weftgraph.sources import table_use

SOURCES = [
    ("app/models.py", "python", "from sqlalchemy.orm import declarative_base\nBase = declarative_base()\n\nclass Client(Base):\n    __tablename__ = \"clients\"\n    id = 1\n    def twin(self):\n        return Client()\n"),
    ("app/views.py", "python", "from app.models import Client\n\ndef listed(session):\n    return session.query(Client).all()\n\ndef route():\n    return listed(None)\n"),
    ("app/named.py", "python", "from .models import (\n    Client as C,\n)\nclass V:\n    def get(self):\n        # Client\n        return C.all()\n"),
    ("app/whole.py", "python", "import app.models\ndef f():\n    return app.models.Client\n"),
    ("app/part.py", "python", "from app import models\nx = models.Client\n"),
    ("db/1.sql", "sql", "CREATE TABLE IF NOT EXISTS public.\"bills\" (id int);\n"),
    ("app/report.py", "python", "def totals(db):\n    return db.execute(\"select * from bills join Clients on 1\")\n\ndef more(db):\n    q = '''\n    update public.bills set a = 1\n    '''\n    return 'from nowhere'\n"),
    ("app/other.py", "python", "class Client:\n    pass\n\ndef noise(d, bills):\n    # delete from bills\n    d.update(bills)\n    return Client()\n"),
    ("app/like.py", "python", "from app.other import Client\ndef g():\n    return Client()\n"),
    ("ui/row.ts", "typescript", "import { Client } from './none'\nexport function Row(items: string[]) {\n  return Array.from(bills) + Client;\n}\n"),
    ("ui/schema.ts", "typescript", "import { pgTable } from 'kit'\nexport const goods = pgTable('goods', {})\nfunction own() {\n  return goods.id;\n}\n"),
    ("ui/use.ts", "typescript", "import { goods as g } from './schema'\nfunction all() {\n  return db.select().from(g);\n}\nfunction sql() {\n  return run(`select a from goods`);\n}\n"),
    ("db/s.prisma", "prisma", "model OpenBill {\n  id Int\n  @@map(\"open_bills\")\n}\n"),
    ("ui/kit.ts", "typescript", "function q() {\n  return prisma.openBill.findMany() + other.openBill;\n}\nfunction no() {\n  return openBill;\n}\n"),
    ("n.py", "python", None),
]


def test_models_and_texts_link_and_look_alikes_do_not(spark):
    df = spark.createDataFrame(SOURCES, "path string, lang string, text string")
    got = sorted((r.path, r.symbol or "", r.table, r.line) for r in table_use.table_uses(df).collect())
    assert got == sorted([
        ("app/named.py", "get", "clients", 7), ("app/part.py", "", "clients", 2), ("app/report.py", "more", "bills", 6), ("app/report.py", "totals", "bills", 2), ("app/report.py", "totals", "clients", 2),
        ("app/models.py", "twin", "clients", 8), ("app/views.py", "listed", "clients", 4), ("app/whole.py", "f", "clients", 3),
        ("ui/kit.ts", "q", "open_bills", 2), ("ui/schema.ts", "own", "goods", 4), ("ui/use.ts", "all", "goods", 3), ("ui/use.ts", "sql", "goods", 6),
    ])
    assert table_use.table_uses(df.where("false")).count() == 0


def test_a_bloom_filter_loses_nothing_and_passes_little(spark):
    values = spark.range(0, 20_000, 7).select(F.concat(F.lit("w"), "id").alias("w")).union(spark.sql("select cast(null as string)"))
    test = bloom_filter(values, "w")
    asked = spark.range(40_000).select("id", F.concat(F.lit("w"), "id").alias("w"))
    passed = asked.where(test(F.col("w")))
    assert passed.join(values, "w", "left_semi").count() == values.where("w is not null").count()
    assert passed.count() < 1.05 * values.count() + 100
    assert spark.sql("select cast(null as string) as w").where(test(F.col("w"))).count() == 0
    assert asked.where(bloom_filter(values.where("false"), "w")(F.col("w"))).count() == 0
