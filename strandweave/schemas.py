"""Schemas of the domain's tables, as DDL."""

REGION = "struct<from:int,to:int>"
GENES = "species string, gene string, length int, pos int, dir int, trunc int, ord bigint"
HITS = "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, dist float, score float, dir int, ord bigint"
PACKED_HITS = "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, ident float, eval float, score float, pam float"
SPECIES_TREE = "node_id int, parent_id int, label string, species string, count_once boolean, weight double, profile array<bigint>"
DOMAINS = "component bigint, cluster_id bigint, species string, gene string, dom int, `from` int, `to` int, subgroup int"
TREE = "component bigint, cluster_id bigint, node_id bigint, parent_id bigint, side int, score double, dist double, gene string, dom int, `from` int, `to` int"
NEIGHBORS = "left_id bigint, right_id bigint, dir int, cnt int, status int"
LINKED_NODE = (
    "struct<id:int,name:string,count:int,length:int,core_from:int,core_to:int,species:array<bigint>,trunc:int,kind:int,child1:int,child2:int,dist:double,score:double,"
    "parent:int,parent_left:int,parent_right:int,cut_from:int,cut_to:int,joined_from:int,joined_to:int,gone:boolean>"
)
LINKED = f"component bigint, n_edges bigint, nodes array<{LINKED_NODE}>, links array<struct<left:int,right:int,count:int,status:int>>"
