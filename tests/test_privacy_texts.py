"""C9 on the other recorded texts, and alias maps kept over runs."""

from jobacct.operators import privacy as P
from jobacct.plans import queries as Q
from jobacct.session import scratch_path


def lines(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, seq bigint").repartition(3)


def text(df):
    return [r.value for r in df.orderBy("seq").collect()]


def test_all_four_texts_share_one_map(spark):
    queue = lines(spark, "USER/ST/NODES/PARTITION/CPUS/NODELIST/OVER", "ann/R/1/big/4/n1/OK", "bob9/PD/2/big/8/(null)/NO", "", "ann/R/2/small/4/n[1-2]/OK", "no separator", "cut/R")
    inventory = lines(spark, "n2,64", "n1,32", "alone", "  ", "None,8", ",5")
    description = lines(
        spark, "NodeName=n1 Arch=x86 NodeAddr=10.0.0.7 NodeHostName=n1", "   CPUTot=8", "   Partitions=small,big,,new ", "NodeName=N/A NodeAddr=n2", "", "Partitions= none"
    )
    names = lines(spark, " n2 ", "", "n3\t")
    out, amap = P.pseudonymize_texts(spark, [(P.QUEUE, queue), (P.INVENTORY, inventory), (P.DESCRIPTION, description), (P.NODE_NAMES, names)])
    assert text(out[0]) == [
        "USER/ST/NODES/PARTITION/CPUS/NODELIST/OVER", "alice/R/1/partition-00/4/node-000/OK", "bob/PD/2/partition-00/8/(null)/NO", "",
        "alice/R/2/partition-01/4/node-001/OK", "no separator", "charlie/R",
    ]
    assert text(out[1]) == ["node-002,64", "node-000,32", "alone", "  ", "None,8", ",5"]
    assert text(out[2]) == [
        "NodeName=node-000 Arch=x86 NodeAddr=node-003 NodeHostName=node-000", "   CPUTot=8", "   Partitions=partition-01,partition-00,,partition-02 ",
        "NodeName=N/A NodeAddr=node-002", "", "Partitions= none",
    ]
    assert text(out[3]) == ["node-002", "", "node-004"]
    got = {(r.kind, r.value): r.alias for r in amap.collect()}
    assert got[("node", "n[1-2]")] == "node-001" and got[("user", "cut")] == "charlie" and len(got) == 3 + 3 + 5


def test_a_kept_map_goes_on(spark):
    path = scratch_path(spark, "alias-test")
    many = [f"u{i:02d}/R/1/p/1/n{i}/OK" for i in range(30)]
    whole, _ = P.pseudonymize_texts(spark, [(P.QUEUE, lines(spark, *many))])
    made = []
    for part in (many[:10], many[:12], many[12:28], many[5:]):
        (out,), amap = P.pseudonymize_texts(spark, [(P.QUEUE, lines(spark, *part))], known=P.load_map(spark, path))
        P.save_map(amap, path)
        made.append(text(out))
    want = text(whole[0])
    assert made == [want[:10], want[:12], want[12:28], want[5:]]
    kept = P.load_map(spark, path)
    assert kept.count() == 30 + 30 + 1 == kept.select("kind", "alias").distinct().count()
    assert {r.value: r.alias for r in kept.where("kind = 'user'").collect()}["u26"] == "user026"


def test_a_dump_after_texts_uses_their_aliases(spark, sf_small):
    users = [r[0] for r in Q.bronze(spark, sf_small).where("User <> ''").select("User").distinct().limit(3).collect()]
    _, known = P.pseudonymize_texts(spark, [(P.QUEUE, lines(spark, *(f"{u}/R/1/p/1/n/OK" for u in users)))])
    out, amap = P.pseudonymize(spark, Q.bronze(spark, sf_small), known=known)
    first = {r.value: r.alias for r in amap.where("kind = 'user'").collect()}
    assert [first[u] for u in users] == ["alice", "bob", "charlie"]
    assert {r[0] for r in out.select("User").distinct().collect()} - {""} <= set(first.values())


def test_nothing_to_map(spark):
    (out,), amap = P.pseudonymize_texts(spark, [(P.QUEUE, lines(spark, "USER/x", ""))])
    assert text(out) == ["USER/x", ""] and amap.count() == 0
    (out,), _ = P.pseudonymize_texts(spark, [(P.NODE_NAMES, lines(spark, "x").limit(0))])
    assert out.count() == 0
