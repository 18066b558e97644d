"""Explicit schemas of the record formats, as DDL."""

from __future__ import annotations

# Field names of the record formats.
ENTITIES = "map<string, struct<label: string, description: string>>"
GRAPH = "struct<node_list: array<string>, edge_list: array<array<string>>, edge_index: array<array<long>>>"
GRAPH_RECORD = (
    f"title string, id string, graph {GRAPH}, questions array<string>, answers array<string>, full_answers array<string>, "
    "question_types array<string>, question_groups array<string>, question_subgroups array<string>, "
    "q_entities array<array<string>>, a_entities array<array<string>>"
)
SCENES = (
    "map<string, struct<objects: map<string, struct<name: string, x: int, y: int, w: int, h: int, attributes: array<string>, "
    "relations: array<struct<name: string, object: string>>>>>>"
)
SCENE_QUESTIONS = "image_id string, question string, answer string, full_answer string"
PREDICTION = (
    "graph_id string, question_id string, question string, target array<string>, true_hop int, recurrence_k int, adapter_id string, "
    "adapter_control string, raw_response string, response string, correct boolean, latency_seconds double, peak_memory_bytes long, "
    "step_pooled_hidden_states array<array<double>>, metadata struct<split: string, question_type: string, source_node: string, "
    "target_node: string, shortest_path: array<string>, structural_distance: int, structural_reachable: boolean, candidate_relations: array<string>>"
)
LEGACY_PREDICTION = (
    "id string, question string, raw_response string, response string, raw_response_no_sample string, response_no_sample string, "
    "evidence string, target array<string>"
)
PROMPT_CACHE = "index long, prompt_sha256 string, response struct<query: string, response: string, timestamp: string, status: string, error: string>"
TASK_SET = "context_samples array<string>, qa_samples array<string>"
