from huddle.functions.exact import average, summarise, with_average
from huddle.functions.numeric import round_ref
from huddle.functions.names import (drafting_team_name, map_get_or, matchup_team_name,
                                   player_name, player_position)
from huddle.functions.jsontext import dumps_entries

__all__ = [
    "average", "round_ref", "summarise", "with_average",
    "drafting_team_name", "map_get_or", "matchup_team_name", "player_name",
    "player_position", "dumps_entries",
]
