"""Schemas of the tables, as DDL."""

TARGET = "struct<class_name:string,synset_id:string,gt_nature:boolean,gt_biotic:boolean,gt_material:boolean>"
TARGETS = f"array<{TARGET}>"
LABELS = "array<struct<reasoning:string,nature:string,biotic:string,material:string,parse_failed:boolean,vlm_called:boolean>>"
FINALS = (
    "array<struct<object:string,mapped:boolean,mapped_synset:string,final_nature:boolean,final_biotic:boolean,final_material:boolean,"
    "nature_source:string,biotic_source:string,material_source:string>>"
)

#: One image and its ground truth.
INSTANCE = f"image_path string, targets {TARGETS}"
#: A taxonomy's edges, its own labels and its words.
EDGES = "parent string, child string, edge_seq long"
NODE_LABELS = "node string, is_nature boolean, life_category string, tangibility string"
LEMMAS = "node string, lemma string, node_seq long, lemma_seq long"
SENSES = "word string, rank int, node string"
#: A closed set of classes; ties go to the smaller index.
CANDIDATES = "cand_idx int, class_name string, node string, gt_nature boolean, gt_biotic boolean"
#: An annotated image; the three arrays are aligned.
IMAGE = f"image_path string, targets {TARGETS}, caption string, objects array<string>, object_labels {LABELS}, object_finals {FINALS}"
#: Lines of an artifact.
RECORD = f"record_type string, {IMAGE}"
HEADER = "record_type string, dataset string, model string, max_hops int, candidate_vocab string, inference_time_seconds double"
#: Multi-label detections.
DETECTIONS = "image_id long, category_id int, name string, y_true boolean, score double"
#: A post's media slot.
SLOT = "language string, platform_id string, slot int, file string, gt_nature boolean, gt_biotic boolean, gt_material boolean"
#: One metric block, and a store of them.
METRICS = "accuracy double, precision double, recall double, f1 double, precision_neg double, recall_neg double, f1_neg double, support long"
RESULTS = f"dataset string, model string, {METRICS}, evaluated_at timestamp"

# What a model answers.
EXTRACTION = "objects array<string>"
FULL_LABEL = "nature_reasoning string, nature string, sub_axes_reasoning string, life_category string, tangibility string"
MATERIAL_LABEL = "reasoning string, tangibility string"
