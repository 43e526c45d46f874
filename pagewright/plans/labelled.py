"""The default labelled questions."""

# ---- fixed values: questions and what counts as a relevant result --------------------------------------
LABELLED = [
    {"id": "obc_on", "q": "What is the procedure for switching on OBC?", "accept": [{"fcp_number": "5201"}], "note": "body"},
    {"id": "obc_reset", "q": "How do I perform an OBC system reset?", "accept": [{"fcp_number": "5203"}], "note": "body"},
    {"id": "obc_cpu", "q": "OBC CPU reset procedure", "accept": [{"fcp_number": "5204"}], "note": "body"},
    {"id": "tc_link", "q": "telecommand link test procedure", "accept": [{"fcp_number": "5215"}], "note": "body"},
    {"id": "hga_motors", "q": "Which FCP is used to switch on HGA motors?", "accept": [{"fcp_number": "5957"}], "note": "index"},
    {"id": "tone_rng", "q": "tone ranging of transponder-1 procedure", "accept": [{"fcp_number": "6009"}], "note": "index"},
    {"id": "star_ss1", "q": "powering on star sensor-1", "accept": [{"fcp_number": "5412"}], "note": "index"},
    {"id": "gyro_on", "q": "gyro power on, off and selection", "accept": [{"fcp_number": "5601"}], "note": "index"},
    {"id": "latch_valve", "q": "opening and closing of latch valves", "accept": [{"fcp_number": "5652"}], "note": "index"},
    {"id": "suit_on", "q": "SUIT payload on procedure", "accept": [{"fcp_number": "6219"}], "note": "index"},
    {"id": "safety", "q": "What are the safety logics?", "note": "procedure or safe-mode text",
     "accept": [{"fcp_number": "5245"}, {"text_contains_any": ["safe mode", "safety logic", "fdi", "fdir"]}]},
    {"id": "payload_gl", "q": "What are the guidelines for Payload operations?", "note": "payload section",
     "accept": [{"subsystem": "PAYLOAD", "text_contains_any": ["payload sequencer", "pop", "mep", "proposal"]},
                {"text_contains_any": ["payload sequencer", "master mep"]}]},
    {"id": "orbit", "q": "What are the orbit constraints?", "note": "orbit design",
     "accept": [{"source_doc": "MOR", "text_contains_any": ["halo", "sev", "sun earth", "orbit"]}]},
    {"id": "mrs_diagram", "q": "Provide me the MRS recovery flow diagram", "note": "figure",
     "accept": [{"text_contains_any": ["master recovery", "safe mode recovery", "mrs"]},
                {"content_type": "image_caption", "source_doc": "MOR"}]},
    {"id": "cmds_date", "q": "What commands were uplinked on 2026-06-09?", "accept": [{"date": "2026-06-09"}], "note": "log"},
]
