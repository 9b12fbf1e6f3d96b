"""Fixed facial tables: blendshape order, action-unit members, mirror partners."""

from __future__ import annotations

# fixed values: blendshape order of the face tracker
BLENDSHAPES = (
    "Brow_Lowerer_L Brow_Lowerer_R Cheek_Puff_L Cheek_Puff_R Cheek_Raiser_L Cheek_Raiser_R "
    "Cheek_Suck_L Cheek_Suck_R Chin_Raiser_B Chin_Raiser_T Dimpler_L Dimpler_R Eyes_Closed_L "
    "Eyes_Closed_R Eyes_Look_Down_L Eyes_Look_Down_R Eyes_Look_Left_L Eyes_Look_Left_R "
    "Eyes_Look_Right_L Eyes_Look_Right_R Eyes_Look_Up_L Eyes_Look_Up_R Inner_Brow_Raiser_L "
    "Inner_Brow_Raiser_R Jaw_Drop Jaw_Sideways_Left Jaw_Sideways_Right Jaw_Thrust Lid_Tightener_L "
    "Lid_Tightener_R Lip_Corner_Depressor_L Lip_Corner_Depressor_R Lip_Corner_Puller_L "
    "Lip_Corner_Puller_R Lip_Funneler_LB Lip_Funneler_LT Lip_Funneler_RB Lip_Funneler_RT "
    "Lip_Pucker_L Lip_Pucker_R Lip_Stretcher_L Lip_Stretcher_R Lip_Suck_LB Lip_Suck_LT Lip_Suck_RB "
    "Lip_Suck_RT Lip_Pressor_L Lip_Pressor_R Lip_Tightener_L Lip_Tightener_R Lips_Toward "
    "Lower_Lip_Depressor_L Lower_Lip_Depressor_R Mouth_Left Mouth_Right Nose_Wrinkler_L "
    "Nose_Wrinkler_R Outer_Brow_Raiser_L Outer_Brow_Raiser_R Upper_Lid_Raiser_L Upper_Lid_Raiser_R "
    "Upper_Lip_Raiser_L Upper_Lip_Raiser_R"
).split()

# fixed values: action unit -> name stems of its members (a unit averages both sides)
UNIT_STEMS = {
    "AU1_inner_brow_raiser": ("Inner_Brow_Raiser",), "AU2_outer_brow_raiser": ("Outer_Brow_Raiser",),
    "AU4_brow_lowerer": ("Brow_Lowerer",), "AU5_upper_lid_raiser": ("Upper_Lid_Raiser",),
    "AU6_cheek_raiser": ("Cheek_Raiser",), "AU7_lid_tightener": ("Lid_Tightener",),
    "AU8_lips_toward": ("Lips_Toward",), "AU9_nose_wrinkler": ("Nose_Wrinkler",),
    "AU10_upper_lip_raiser": ("Upper_Lip_Raiser",), "AU12_lip_corner_puller": ("Lip_Corner_Puller",),
    "AU14_dimpler": ("Dimpler",), "AU15_lip_corner_depressor": ("Lip_Corner_Depressor",),
    "AU16_lower_lip_depressor": ("Lower_Lip_Depressor",), "AU17_chin_raiser": ("Chin_Raiser",),
    "AU18_lip_pucker": ("Lip_Pucker",), "AU20_lip_stretcher": ("Lip_Stretcher",),
    "AU22_lip_funneler": ("Lip_Funneler",), "AU23_lip_tightener": ("Lip_Tightener",),
    "AU24_lip_pressor": ("Lip_Pressor",), "AU26_jaw_drop": ("Jaw_Drop",), "AU28_lip_suck": ("Lip_Suck",),
    "AU29_jaw_thrust": ("Jaw_Thrust",), "AU30_jaw_sideways": ("Jaw_Sideways",),
    "AU33_cheek_puff": ("Cheek_Puff",), "AU35_cheek_suck": ("Cheek_Suck",),
    "AU43_eyes_closed": ("Eyes_Closed",), "mouth_sideways": ("Mouth",),
}
# fixed values: units with reported links to negation
NEGATION_UNITS = (
    "AU1_inner_brow_raiser", "AU2_outer_brow_raiser", "AU4_brow_lowerer", "AU9_nose_wrinkler",
    "AU10_upper_lip_raiser", "AU14_dimpler", "AU15_lip_corner_depressor", "AU17_chin_raiser",
    "AU20_lip_stretcher", "AU23_lip_tightener", "AU24_lip_pressor",
)
SIDES = ("", "_L", "_R", "_LB", "_LT", "_RB", "_RT", "_B", "_T", "_Left", "_Right")


def unit_members(subset: str = "all") -> dict[str, list[int]]:
    """Blendshape indices of every action unit of the subset."""
    units = NEGATION_UNITS if subset == "negation" else UNIT_STEMS
    return {
        unit: [i for i, name in enumerate(BLENDSHAPES) if name in {s + e for s in UNIT_STEMS[unit] for e in SIDES}]
        for unit in units
    }


def mirror_partner(name: str) -> str:
    """Name with its left and right tokens exchanged; names without a side stay."""
    swap = {"Left": "Right", "Right": "Left", "L": "R", "R": "L", "LB": "RB", "RB": "LB", "LT": "RT", "RT": "LT"}
    return "_".join(swap.get(token, token) for token in name.split("_"))
