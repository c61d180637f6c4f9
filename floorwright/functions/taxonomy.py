"""Label dictionaries: classes, colours and roles, and the mapping of room types to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORE = 255


#: Dictionary, class id, name, colour and role of each class.
CLASSES = (
    ("coarse", 0, "background", (255, 255, 255), ""),
    ("coarse", 1, "wall", (38, 38, 38), "wall"),
    ("coarse", 2, "room", (129, 199, 235), "room"),
    ("coarse", 3, "door", (236, 112, 99), "door"),
    ("coarse", 4, "window", (88, 214, 141), "window"),
    ("cubicasa12", 0, "background", (255, 255, 255), ""),
    ("cubicasa12", 1, "outdoor", (170, 214, 136), "room"),
    ("cubicasa12", 2, "wall", (38, 38, 38), "wall"),
    ("cubicasa12", 3, "kitchen", (255, 190, 92), "room"),
    ("cubicasa12", 4, "living_room", (129, 199, 235), "room"),
    ("cubicasa12", 5, "bedroom", (186, 148, 222), "room"),
    ("cubicasa12", 6, "bath", (99, 179, 196), "room"),
    ("cubicasa12", 7, "entry", (240, 230, 140), "room"),
    ("cubicasa12", 8, "railing", (140, 140, 140), ""),
    ("cubicasa12", 9, "storage", (205, 170, 125), "room"),
    ("cubicasa12", 10, "garage", (160, 160, 200), "room"),
    ("cubicasa12", 11, "undefined", (210, 225, 240), "room"),
    ("cubicasa12", 12, "door", (236, 112, 99), "door"),
    ("cubicasa12", 13, "window", (88, 214, 141), "window"),
)


class Taxonomy:
    """A dictionary of classes: what its rows of CLASSES say."""

    def __init__(self, name: str):
        self.name = name
        self.rows = [row[1:] for row in CLASSES if row[0] == name]
        self.classes = tuple(row[1] for row in self.rows)
        self.colors = tuple(row[2] for row in self.rows)

    def ids(self, role: str) -> tuple[int, ...]:
        return tuple(row[0] for row in self.rows if row[3] == role)

    wall = property(lambda self: self.ids("wall")[0])
    door = property(lambda self: self.ids("door")[0])
    window = property(lambda self: self.ids("window")[0])
    rooms = property(lambda self: self.ids("room"))


TAXONOMIES = {name: Taxonomy(name) for name in dict.fromkeys(row[0] for row in CLASSES)}
COARSE, TWELVE = TAXONOMIES["coarse"], TAXONOMIES["cubicasa12"]
#: Room types that aren't class 11 in the fourteen-class dictionary.
ROOM_CLASSES = {"Bath": 6, "Bedroom": 5, "CarPort": 10, "Closet": 9, "Den": 4, "Dining": 4, "DraughtLobby": 7, "DressingRoom": 9, "EatingArea": 4, "Entry": 7, "Garage": 10, "Hall": 7, "HallWay": 7, "Kitchen": 3, "LivingRoom": 4, "Lounge": 4, "Outdoor": 1, "Pantry": 9, "Reception": 7, "Sauna": 6, "Storage": 9, "Railing": 8}
#: Fixed value: the class of every other room type.
OTHER_ROOM = 11


def taxonomy(name: str) -> Taxonomy:
    if name not in TAXONOMIES:
        raise ValueError(f"unknown taxonomy {name!r}; there are {sorted(TAXONOMIES)}")
    return TAXONOMIES[name]


def table(spark: SparkSession) -> DataFrame:
    """(taxonomy, class_id, name, rgb, is_wall, is_door, is_window, is_room) of all dictionaries."""
    rows = [(name, i, c, list(rgb), *(role == r for r in ("wall", "door", "window", "room"))) for name, i, c, rgb, role in CLASSES]
    return spark.createDataFrame(rows, "taxonomy string, class_id int, name string, rgb array<int>, is_wall boolean, is_door boolean, is_window boolean, is_room boolean")


def room_class(room_type: Column, name: str = "coarse") -> Column:
    """The class of a room type. In the coarse dictionary a railing is background, all else a room."""
    if taxonomy(name).name == "coarse":
        return F.when(room_type == "Railing", 0).otherwise(2)
    known = F.create_map(*[F.lit(x) for kv in ROOM_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, room_type), F.lit(OTHER_ROOM))
