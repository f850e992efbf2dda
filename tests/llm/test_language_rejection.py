"""What is not of a learned language is rejected, whatever its script; clean
texts of the learned languages stay at every length."""

import random
import string

from pyspark.sql import functions as F

from shoplens.llm.language_id import fit, pieces

SF = "/root/testdata/sf0.01"

FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem "
          "i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
          "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve "
          "birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "cy": "Genir pawb yn rhydd ac yn gydradd â'i gilydd mewn urddas a hawliau. Fe'u cynysgaeddir â rheswm a "
          "chydwybod, a dylai pawb ymddwyn y naill at y llall mewn ysbryd cymodlon.",
}


def test_unlearned_latin_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(fold != 2), sample=150)
    rnd = random.Random(3)
    noise = {"letters": " ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randrange(2, 10))) for _ in range(40)),
             "base64": "".join(rnd.choices(string.ascii_letters + string.digits + "+/", k=300)),
             "hex": "".join(rnd.choices("0123456789abcdef", k=300))}
    got = {k: model.predict(t) for k, t in (FOREIGN | noise).items()}
    assert all(r for _, _, r in got.values()), got
    held = [r.text for r in docs.where(fold == 2).where("lang is not null and text is not null").collect()]
    assert not any(model.predict(t)[2] for t in held)
    short = [p for t in held for p in pieces(t)[:5]]
    assert sum(model.predict(p)[2] for p in short) <= 0.01 * len(short)
