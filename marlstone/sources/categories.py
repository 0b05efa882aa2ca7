"""Static category tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Category id, its taxonomy node and its display name. Ids have
# gaps, and names differ from the nodes' words.
CATEGORIES = [
    (1, "person.n.01", "person"), (2, "bicycle.n.01", "bicycle"), (3, "car.n.01", "car"), (4, "motorcycle.n.01", "motorcycle"),
    (5, "airplane.n.01", "airplane"), (6, "bus.n.01", "bus"), (7, "train.n.01", "train"), (8, "truck.n.01", "truck"),
    (9, "boat.n.01", "boat"), (10, "traffic_light.n.01", "traffic light"), (11, "fireplug.n.01", "fire hydrant"),
    (13, "street_sign.n.01", "stop sign"), (14, "parking_meter.n.01", "parking meter"), (15, "bench.n.01", "bench"),
    (16, "bird.n.01", "bird"), (17, "cat.n.01", "cat"), (18, "dog.n.01", "dog"), (19, "horse.n.01", "horse"),
    (20, "sheep.n.01", "sheep"), (21, "cow.n.01", "cow"), (22, "elephant.n.01", "elephant"), (23, "bear.n.01", "bear"),
    (24, "zebra.n.01", "zebra"), (25, "giraffe.n.01", "giraffe"), (27, "backpack.n.01", "backpack"), (28, "umbrella.n.01", "umbrella"),
    (31, "bag.n.04", "handbag"), (32, "necktie.n.01", "tie"), (33, "bag.n.06", "suitcase"), (34, "frisbee.n.01", "frisbee"),
    (35, "ski.n.01", "skis"), (36, "snowboard.n.01", "snowboard"), (37, "ball.n.01", "sports ball"), (38, "kite.n.03", "kite"),
    (39, "baseball_bat.n.01", "baseball bat"), (40, "baseball_glove.n.01", "baseball glove"), (41, "skateboard.n.01", "skateboard"),
    (42, "surfboard.n.01", "surfboard"), (43, "tennis_racket.n.01", "tennis racket"), (44, "bottle.n.01", "bottle"),
    (46, "wineglass.n.01", "wine glass"), (47, "cup.n.01", "cup"), (48, "fork.n.01", "fork"), (49, "knife.n.01", "knife"),
    (50, "spoon.n.01", "spoon"), (51, "bowl.n.01", "bowl"), (52, "banana.n.02", "banana"), (53, "apple.n.01", "apple"),
    (54, "sandwich.n.01", "sandwich"), (55, "orange.n.01", "orange"), (56, "broccoli.n.02", "broccoli"), (57, "carrot.n.01", "carrot"),
    (58, "hotdog.n.02", "hot dog"), (59, "pizza.n.01", "pizza"), (60, "doughnut.n.02", "donut"), (61, "cake.n.03", "cake"),
    (62, "chair.n.01", "chair"), (63, "sofa.n.01", "couch"), (64, "pot_plant.n.01", "potted plant"), (65, "bed.n.01", "bed"),
    (67, "dining_table.n.01", "dining table"), (70, "toilet.n.02", "toilet"), (72, "television_receiver.n.01", "tv"), (73, "laptop.n.01", "laptop"),
    (74, "mouse.n.04", "mouse"), (75, "remote_control.n.01", "remote"), (76, "computer_keyboard.n.01", "keyboard"),
    (77, "cellular_telephone.n.01", "cell phone"), (78, "microwave.n.02", "microwave"), (79, "oven.n.01", "oven"), (80, "toaster.n.02", "toaster"),
    (81, "sink.n.01", "sink"), (82, "refrigerator.n.01", "refrigerator"), (84, "book.n.02", "book"), (85, "clock.n.01", "clock"),
    (86, "vase.n.01", "vase"), (87, "scissors.n.01", "scissors"), (88, "teddy.n.01", "teddy bear"), (89, "hand_blower.n.01", "hair drier"),
    (90, "toothbrush.n.01", "toothbrush"),
]

# Words that stand for a node whatever their own senses.
SYNONYMS = {"person.n.01": ("boy", "girl", "man", "woman", "kid", "child", "guy", "lady")}


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category_id int, node string, name string")


def synonyms(spark: SparkSession) -> DataFrame:
    """word and the node that it stands for."""
    return spark.createDataFrame([(w, n) for n, words in SYNONYMS.items() for w in words], "word string, node string")
