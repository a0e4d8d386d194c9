"""The routing rules that the queries use. All are fixed values: users of detection tables rely on these prompts, labels, routes and reasons."""

from verdigris.operators.scores import Route, RouteTexts

ROUTES = [
    Route(("adult butterfly", "butterfly", "live adult butterfly"), ("adult_butterfly", "butterfly_like"), "adult_butterfly_field", "adult_field", "score", "definite_adult_prompt"),
    Route(("butterfly wing", "lepidoptera", "possible adult butterfly"), ("possible_adult_butterfly",), "adult_butterfly_field", "adult_field", "score", "possible_adult_prompt_above_threshold",
          "possible_adult", "possible_adult_route_disabled", "possible_adult_route_below_threshold", ":route_disabled"),
    Route(("butterfly caterpillar", "caterpillar", "larva"), ("caterpillar",), "caterpillar_field", "larval", "score", "larval_prompt"),
    Route(("butterfly chrysalis", "chrysalis", "pupa"), ("pupa",), "pupa_or_chrysalis", None, "exclude", "pupa_prompt_no_bioclip_route"),
    Route(("butterfly specimen", "pinned butterfly", "pinned butterfly specimen"), ("pinned_specimen",), "pinned_specimen", "pinned_specimen", "score", "pinned_specimen_prompt"),
    Route(("moth", "other insect"), ("moth_like",), "possible_moth_or_other_insect", None, "exclude", "other_insect_prompt"),
    Route(("insect", "insect-like organism"), ("insect_like",), "ambiguous_visual_domain", "adult_field", "review", "ambiguous_insect_review_above_threshold",
          "ambiguous_insect", "ambiguous_insect_review_disabled", "ambiguous_insect_review_below_threshold", ":review_disabled"),
    Route(("artwork", "butterfly artwork", "butterfly logo", "butterfly tattoo", "drawing", "logo", "museum label", "painting", "pattern", "sign", "tattoo", "text", "textile"), ("artifact", "hard_negative"),
          "artwork_logo_tattoo_or_other_artifact", None, "exclude", "artifact_prompt"),
    Route(("flower", "hand", "leaf", "no relevant organism", "person"), ("no_organism", "no_relevant_organism"), "no_relevant_organism", None, "exclude", "no_relevant_organism_prompt"),
]
TEXTS = RouteTexts("no_relevant_organism", "ambiguous_visual_domain", "detector_reported_no_detection", "detection_status_not_routable", "invalid_detector_score", "unknown_detector_prompt", "unknown_detector_label_fallback", "legacy_detector_label_fallback:", ":below_threshold")
THRESHOLDS = {"possible_adult": 0.35, "ambiguous_insect": 0.35}
