"""Declarations of the test tables that the queries run on."""

from tidewell.plans.schema import FloatField, ForeignKey, IntegerField, StringField, Table, TimestampField


class Region(Table):
    r_regionkey = IntegerField(primary=True)
    r_name = StringField()


class Nation(Table):
    n_nationkey = IntegerField(primary=True)
    n_name = StringField()
    n_regionkey = ForeignKey(Region)


class Customer(Table):
    c_custkey = IntegerField(primary=True)
    c_name = StringField()
    c_nationkey = ForeignKey(Nation)
    c_acctbal = FloatField()
    c_mktsegment = StringField()


class Supplier(Table):
    s_suppkey = IntegerField(primary=True)
    s_name = StringField()
    s_nationkey = ForeignKey(Nation)
    s_acctbal = FloatField()


class Part(Table):
    p_partkey = IntegerField(primary=True)
    p_name = StringField()
    p_brand = StringField()
    p_type = StringField()
    p_size = IntegerField()
    p_retailprice = FloatField()


class Orders(Table):
    o_orderkey = IntegerField(primary=True)
    o_custkey = ForeignKey(Customer)
    o_orderstatus = StringField()
    o_totalprice = FloatField()
    o_orderdate = TimestampField()
    o_orderpriority = StringField()


class Lineitem(Table):
    """Has no unique key; its order's stands in, and nothing is upserted by it."""

    l_orderkey = ForeignKey(Orders, primary=True)
    l_partkey = ForeignKey(Part)
    l_suppkey = ForeignKey(Supplier)
    l_linenumber = IntegerField()
    l_quantity = FloatField()
    l_extendedprice = FloatField()
    l_discount = FloatField()
    l_tax = FloatField()


class NationPeer(Table):
    """Nations with a neighbour: a key to the same kind of rows."""

    table_name = "nation_peer"
    n_nationkey = IntegerField(primary=True)
    n_name = StringField()
    peer_key = ForeignKey(Nation)
